"""Each operator against a brute-force version, and on nulls, empties, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, line_dedup, merkle, mixing, near_dedup, quality, secrets, sharding, token_counts, token_output
from tallyspark.llm.words import WordHashes, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs_of(spark, texts, sources=None):
    rows = [(k, t, "en", sources[k] if sources else f"s{k % 3}", len(t) if t else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_docs(spark):
    """Null and empty texts, a null id, a repeated row, a very long text and a null source."""
    rows = [
        (1, "One line here now\nanother line here", "en", "a", 3), (1, "One line here now\nanother line here", "en", "a", 3),
        (2, None, "en", None, None), (3, "", "en", "b", 0), (None, "text without an id goes last", "en", "a", 1),
        (4, "word " * 30_000, None, "c", 1), (5, "!!! ??? ...", "en", "a", 1), (6, "One line here now\nthird", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60, size=80):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, size))) for _ in range(n)], rng


# 1 ------------------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    found, hit, owners = words(text), set(), set()
    for item_id, item in items:
        target = words(item)
        width = min(10, len(target))
        for at in range(len(target) - width + 1) if width else ():
            window = target[at : at + width]
            for k in range(len(found) - width + 1):
                if found[k : k + width] == window:
                    hit |= set(range(k, k + width))
                    owners.add(str(item_id))
    return len(found), len(hit), sorted(owners)


def test_decontamination_matches_brute_force_in_one_block_and_in_many(spark):
    texts, rng = corpus()
    items = [(k, texts[k][5:140]) for k in range(8)] + [(90, "Short item"), (91, "!!!"), (92, None)]
    texts = [*texts, "prefix SHORT, item suffix", texts[3].upper() + " tail", None, ""]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (32 << 20, 200):
        found = decontamination.with_hits(docs, bench, "h", block_bytes=block).select("doc_id", "h.n_words", decontamination.hit_words(F.col("h")).alias("n"), "h.items").collect()
        assert {r[0]: (r[1], r[2], r[3]) for r in found} == {k: brute_hits(t, items) for k, t in enumerate(texts)}


def test_decontamination_removes_documents_or_spans_and_keeps_columns(spark):
    item = " ".join(LONG[:12])
    docs = docs_of(spark, [f"clean text. {item}! after it", "nothing here", None]).withColumn("hits_0", F.lit(1))
    bench = spark.createDataFrame([(1, item.upper())], "item_id bigint, text string")
    for block in (32 << 20, 16):
        kept = decontamination.decontaminate(docs.withColumn("h1_0", F.lit(1)), bench, block_bytes=block)
        assert kept.columns == [*docs.columns, "h1_0"] and sorted(r.doc_id for r in kept.collect()) == [1, 2]
        cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, mode="spans", block_bytes=block).collect()}
        assert cut == {0: "clean text. ! after it", 1: "nothing here", 2: None}
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.decontaminate(odd_docs(spark), empty).count() == 8
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_a_set_of_windows_takes_a_few_bytes_a_letter():
    import pickle
    import random as chance

    rng = chance.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(2000)]
    size = sum(len(t) for _, t in items)
    ngrams = decontamination.NgramSet(items, 10)
    assert len(pickle.dumps(ngrams)) < 6 * size
    found = words(items[7][1] + " " + items[8][1])
    hit, owners = np.zeros(len(found), bool), set()
    ngrams.scan(found, hit, owners)
    assert hit.all() and owners == {"7", "8"}
    empty = decontamination.NgramSet([(1, None), (2, "")], 10)
    empty.scan(found, np.zeros(len(found), bool), owners)
    assert owners == {"7", "8"}


def test_windows_that_many_items_share_belong_to_all(monkeypatch):
    monkeypatch.setattr(decontamination, "TOGETHER", 7)
    shared = " ".join(f"w{k}" for k in range(12))
    ngrams = decontamination.NgramSet([(k if k else None, f"{shared} {k}") for k in range(50)], 10)
    found = words(f"x {shared} y")
    hit, owners = np.zeros(len(found), bool), set()
    ngrams.scan(found, hit, owners)
    assert owners == {str(k) for k in range(1, 50)} and hit.tolist() == [False, *[True] * 12, False]


# 2 ------------------------------------------------------------------------------------------------------------


def test_secret_scan_finds_assigned_tokens_and_dismisses_prose(spark):
    texts, rng = corpus(seed=5, n=80)
    rows = []
    for k, text in enumerate(texts):
        token = hashlib.sha1(str(k).encode()).hexdigest()
        prose = "".join(rng.choice(LONG[:6]) for _ in range(4))
        rows.append((k, f"{text} token = {token} then {prose} rest", f"src/{k}.py" if k % 2 else None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = secrets.candidates(docs).cache()
    assert found.count() == 160
    scored = secrets.scan(found, secrets.place_labels(found), secrets.dictionary(docs)).collect()
    tokens = {hashlib.sha1(str(k).encode()).hexdigest() for k in range(80)}
    assert {r.token for r in scored if r.score >= 0.5} == tokens
    assert {r.token for r in scored if r.shape_score >= 0.5} == tokens
    odd = secrets.candidates(odd_docs(spark))
    assert odd.count() == 0
    assert secrets.scan(odd, secrets.place_labels(odd), []).count() == 0


def test_secret_candidates_are_all_runs_and_what_is_assigned_to_a_name(spark):
    key, far = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "x" * 70
    texts = {
        f"export AWS_SECRET_ACCESS_KEY={key}": [("AWS_SECRET_ACCESS_KEY", 0, 0.0), (key, 22, 1.0)],
        f"see https://a-very-long-host-name/path?key={key}&n=1": [("//a-very-long-host-name/path", 6, None), (key, 39, None)],
        f'{{"user":"bob","password":"hunter2","note_of_some_length":"{key}"}}': [("hunter2", 26, 1.0), ("note_of_some_length", 36, None), (key, 58, None)],
        "password = p@ss.w0rd and pwd: hunter2": [("p@ss.w0rd", 0, 1.0), ("hunter2", 0, 1.0)],
        f"{far}_token= {key}": [(f"{far}_token=", 0, None), (key, 0, 1.0)],
        f"a \"{key}==\", b": [(f"{key}==", 1, 0.0)],
        "= : ==": [],
    }
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    found = secrets.candidates(docs)
    labels = {(r.doc_id, r.word_index, r.offset): r.label for r in secrets.place_labels(found).collect()}
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.word_index, r.offset))
    for k, wanted in enumerate(texts.values()):
        assert [(r.token, r.offset, labels.get((k, r.word_index, r.offset))) for r in rows if r.doc_id == k] == wanted


def brute_candidates(text):
    """(word_index, offset, token) by plain loops over words and runs, without the operator's filter on words."""
    run, name, found = re.compile(secrets.RUN), re.compile(secrets.ASSIGNED_NAME), []
    all_words = re.split(secrets.SPACE, text or "")
    for k, word in enumerate(all_words):
        before = [all_words[j] if j >= 0 else "" for j in (k - 2, k - 1)]
        pieces, at = [], 0
        for m in run.finditer(word):
            pieces += [word[at : m.start()], m.group()]
            at = m.end()
        pieces.append(word[at:])
        for i in range(1, len(pieces), 2):
            near = "".join(pieces[max(i - 6, 0) : i])
            lead = " ".join([*before, near]) if i < 6 else near
            value = re.match("[^\"'`,;&<>(){}\\[\\]]*", "".join(pieces[i:])).group()
            if re.search("[A-Za-z0-9+/_-]{16}", pieces[i]):
                found.append((k, sum(map(len, pieces[:i])), pieces[i]))
            elif name.search(lead):
                found.append((k, sum(map(len, pieces[:i])), value))
    return found


def test_secret_candidates_match_plain_loops(spark):
    rng = random.Random(17)
    bits = ["token", "password", "api_key", "=", ":", '"', "'", ",", "abc", "x" * 17, "Zz9+/_-" * 3, "==", "secret", "&", "?", "{", "}", "hunter2", "a.b", "ü", "auth", "-", "123456"]
    texts = ["".join(rng.choice([*bits, " ", " ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "")], "doc_id bigint, text string").withColumn("source", F.lit("s"))
    got = defaultdict(list)
    for r in secrets.candidates(docs).collect():
        got[r.doc_id].append((r.word_index, r.offset, r.token))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(brute_candidates(t)) for k, t in enumerate(texts) if brute_candidates(t)}


def test_secret_features_are_counted_per_character(spark):
    """Pairs and coverage against plain loops; a very long token takes time in proportion to its length."""
    rng = random.Random(2)
    tokens = ["".join(rng.choice("abfgxyzABZ019+/_-@é") for _ in range(n)) for n in (1, 2, 17, 60)] + ["passwordsandcastle" * 3, "A0" * 100_000]
    found = spark.createDataFrame([(k, t, "p/config.yml", "next,") for k, t in enumerate(tokens)], "doc_id bigint, token string, path string, after1 string")
    found = found.withColumns({c: F.lit(True) for c in ("is_assigned", "is_named", "is_before_prose")}).withColumn("kind_0", F.lit("mine"))
    odds = {x + y: 0.5 * i - j for i, x in enumerate(secrets.CLASSES) for j, y in enumerate(secrets.CLASSES)}
    known = ["password", "pass", "sand", "sandcastle", "castle", "words"]
    rows = {r.doc_id: r for r in secrets.features(found, odds, known).collect()}
    kind = lambda c: "0" if c in "0123456789" else "f" if c in "abcdef" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "-"
    for k, token in enumerate(tokens):
        kinds = "".join(map(kind, token))
        assert rows[k].transitions == pytest.approx(sum(odds[a + b] for a, b in zip(kinds, kinds[1:], strict=False)) / len(token))
        bare = re.sub("|".join(sorted(known, key=lambda w: -len(w))), "", token.lower())
        assert rows[k].covered == pytest.approx((len(token) - len(bare)) / len(token)) and rows[k].kind_0 == "mine"


def test_secret_query_on_planted_secrets_and_look_alikes(spark, tmp_path):
    """Of documents whose labels no forest saw: planted keys are secrets, long words and numbers aren't."""
    texts, rng = corpus(seed=6, n=240)
    rows, secret = [], {}
    for k, text in enumerate(texts):
        key = hashlib.sha1(str(k).encode()).hexdigest() if k % 3 else "".join(rng.choice("abcdefghijKLMNOPQRS0123456789+/") for _ in range(32))
        lure = "".join(rng.choice(LONG[:6]) for _ in range(4)) if k % 2 else "9807" * 4
        name = rng.choice(["token = ", "password: ", "api_key="])
        half = text.split()[:10]
        rows.append((k, " ".join([*half, f'{name}"{key}" {text} and', lure, *half]), "src"))
        secret |= {(k, hashlib.sha256(key.encode()).hexdigest()): True, (k, hashlib.sha256(lure.encode()).hexdigest()): False}
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.token_sha256): r.is_secret for r in secrets.op2_query(spark, str(tmp_path)).collect()}
    assert set(got) == set(secret)
    unseen = [k for k in got if zlib.crc32(str(k[0]).encode()) % 4 == 2]
    assert len(unseen) > 60 and sum(got[k] == secret[k] for k in unseen) >= 0.97 * len(unseen)


# 3 ------------------------------------------------------------------------------------------------------------


def brute_classes(texts):
    hashes = WordHashes()
    read = {k: near_dedup._read(t, hashes) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if words(texts[a]) and words(texts[a]) == words(texts[b]) or near_dedup.similar(read[a][0], read[b][0], read[a][1], read[b][1]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in texts}


def edited(text, rng, n):
    found = text.split()
    for _ in range(n):
        found[rng.randrange(len(found))] = "x%d" % rng.randrange(10**6)
    return " ".join(found)


@pytest.mark.parametrize("small", [16, 3])
def test_near_classes_match_brute_force(spark, small):
    """Groups of copies with 1 to 8 edits, chains among them; a small key bound sends them through the family blocks."""
    texts, rng = corpus(seed=7, n=25, size=140)
    for base in range(3):
        texts += [edited(texts[base], rng, rng.randint(1, 8)) for _ in range(25)]
    texts += [texts[0].upper() + "!", texts[0], "too short", "too short", "only four words here"]
    rng.shuffle(texts)
    found = near_dedup.near_duplicate_classes(docs_of(spark, texts), small=small, block_rows=8)
    assert {r.doc_id: r.class_id for r in found.collect()} == brute_classes(dict(enumerate(texts)))


@pytest.mark.parametrize("small", [16, 1])
def test_near_classes_lose_no_link_of_short_texts(spark, small):
    """4 of 5 shingles in common, 5 of 6, 8 of 10: few of the sketches' minima agree. A small key bound takes the family blocks."""
    rng = random.Random(3)
    texts = []
    for n in [8] * 250 + [9] * 60 + [12] * 60:
        text = ["w%d" % rng.randrange(10**6) for _ in range(n)]
        texts += [" ".join(text), " ".join([*text, "more"] + (["words"] if n == 12 else []))]
    found = near_dedup.near_duplicate_classes(docs_of(spark, texts), small=small)
    assert {r.doc_id: r.class_id for r in found.collect()} == {k: k - k % 2 for k in range(len(texts))}


def test_near_classes_of_odd_rows(spark):
    found = near_dedup.near_duplicate_classes(odd_docs(spark)).collect()
    assert len(found) == 8
    assert {r.class_id for r in found if r.doc_id == 1} == {1}
    assert {r.doc_id: r.class_id for r in found if r.doc_id in (2, 3, 5)} == {2: 2, 3: 3, 5: 5}
    assert near_dedup.near_duplicate_classes(odd_docs(spark).limit(0)).count() == 0
    docs = odd_docs(spark).withColumn("drop_id", F.lit(0))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]  # the repeated row once


@pytest.mark.parametrize("segment", [1 << 14, 7, 1])
def test_alignment_is_the_longest_common_run_of_words(segment, monkeypatch):
    monkeypatch.setattr(near_dedup, "SEGMENT", segment)
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.2] + [rng.randrange(12) for _ in range(rng.randint(0, 5))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        wide = near_dedup.common_run(np.array(a, np.uint64), np.array(b, np.uint64), 60)
        assert wide == table[-1][-1]
        narrow = near_dedup.common_run(np.array(a, np.uint64), np.array(b, np.uint64), max(len(a), len(b)) // 5 + 1)
        enough = lambda run: 5 * run >= 4 * max(len(a), len(b))  # noqa: B023, E731
        assert narrow <= wide and enough(narrow) == enough(wide)


def test_rarity_table_matches_counts(spark, monkeypatch):
    """Every cell holds the level of its commonest shingle of several classes, in whichever block it lies; no shingles give zeros."""
    monkeypatch.setattr(near_dedup, "CELLS", 256)
    monkeypatch.setattr(near_dedup, "CELL_BLOCK", 16)
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(-400, 400) // rng.choice([1, 40])) for _ in range(2000)] + [(7, 999)] * 50 + [(k, -1) for k in range(64)]
    found = near_dedup._levels(spark.createDataFrame(rows, "class bigint, shingle bigint"))
    texts, classes, want = Counter(s for _, s in rows), defaultdict(set), np.zeros(256, np.uint8)
    for c, s in rows:
        classes[s].add(c)
    for s, n in texts.items():
        if len(classes[s]) > 1:
            want[s % 256] = max(want[s % 256], n.bit_length())
    assert (found == want).all() and want.max() >= 7
    assert not near_dedup._levels(spark.createDataFrame([], "class bigint, shingle bigint")).any()


def test_near_classes_catch_planted_copies(spark):
    """Copies with 1 to 6 words in a hundred replaced, dropped or added: nine in ten at least are caught, and nothing else."""
    rng = random.Random(11)
    vocabulary = ["w%d" % k for k in range(5000)]
    texts, planted = [], 0
    for _ in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 600))]
        copy = []
        rate = rng.uniform(0.01, 0.06)
        for word in base:
            draw = rng.random() / rate
            copy += [rng.choice(vocabulary)] if draw < 0.4 else [] if draw < 0.7 else [word, rng.choice(vocabulary)] if draw < 1 else [word]
        texts += [" ".join(base), " ".join(copy)]
        planted += 1
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs_of(spark, texts)).collect()}
    assert all(c in (k, k - 1) and (c == k or k % 2) for k, c in found.items())
    assert sum(found[k] == k - 1 for k in range(1, len(texts), 2)) >= 0.95 * planted


def test_texts_that_quote_one_passage_stay_apart_and_their_copies_meet(spark):
    """All texts hold a long common passage, so its keys are large; only what is half alike besides links."""
    rng = random.Random(13)
    passage = " ".join("p%d" % k for k in range(60))
    texts = [f"{' '.join('a%d' % rng.randrange(10**6) for _ in range(50))} {passage} {' '.join('b%d' % rng.randrange(10**6) for _ in range(40))}" for _ in range(60)]
    texts += [edited(t, rng, 3) for t in texts[:30]]
    found = near_dedup.near_duplicate_classes(docs_of(spark, texts), small=3, block_rows=16)
    got = {r.doc_id: r.class_id for r in found.collect()}
    assert got == brute_classes(dict(enumerate(texts)))
    assert sum(got[60 + k] == k for k in range(30)) >= 28 and all(got[k] == k for k in range(60))


def test_ids_with_several_texts_and_repeated_rows(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "seven, eight nine ten eleven TWELVE"), (2, "..."), (3, "nothing like it at all here"),
            (3, "nothing like it at all here"), (None, "Nothing like it at all here!"), (None, "only here once more again"), (None, "Only here once more again"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = Counter((r.doc_id, r.class_id) for r in near_dedup.near_duplicate_classes(docs).collect())
    assert found == {(1, 1): 2, (2, 1): 2, (3, 3): 2, (None, 3): 1, (None, None): 3}
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, rows[0][1]), (3, rows[4][1]), (None, "Only here once more again"), (None, None)], key=str)

# 4 ------------------------------------------------------------------------------------------------------------


def test_quality_rules_hold_out_labels_and_separate_junk(spark):
    texts, rng = corpus(seed=3, n=240)
    texts = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in t.split()) if k % 4 == 0 else t for k, t in enumerate(texts)]
    docs = docs_of(spark, texts).withColumn("stats_0", F.lit("mine"))
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(240)], "doc_id bigint, quality int")
    ensemble = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    assert ensemble["rules"]
    scored = quality.score(docs, ensemble)
    assert scored.columns == [*docs.columns, "score"]
    held = [r for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [(r.score >= 0.7) == (r.doc_id % 4 != 0) for r in held]
    assert len(held) > 30 and sum(right) / len(right) > 0.95
    assert quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id")))) == ensemble


def brute_statistics(text):
    text = text or ""
    size, all_words = max(len(text), 1), re.split("[\\x20\\x09-\\x0D]+", text)
    lines = [line for line in text.split("\n") if line]
    n, n_lines = len(all_words), max(len(lines), 1)
    share = lambda pattern: len(re.findall(pattern, text)) / size
    return {
        "log_size": np.log1p(size), "word_length": size / n, "symbols": share(r"[#$%&*+=<>@^_~\\{}\[\]/]"), "symbol_runs": len(re.findall(r"[#$%&*=~^_+]{2,}|!{2,}", text)) / n, "bars": share(r"\|"), "marks": share("[!?]"),
        "stops": len(re.findall("[.,;:]", text)) / n, "capitals": share("[A-Z]"), "digits": share("[0-9]"), "new_words": len(set(all_words)) / n**0.5, "distinct_words": len(set(all_words)) / n, "distinct_lines": len(set(lines)) / n_lines,
        "line_words": np.log1p(n / n_lines),
    }


def test_quality_query_scores_as_its_rules_say_by_hand(spark, tmp_path):
    """Every statistic counted in Python, every rule tried, the weights summed: the compiled column gives the same score."""
    texts, rng = corpus(seed=23, n=200)
    texts = [" ".join(w + rng.choice(["###", "!!", "[]"]) for w in t.split()) if k % 4 == 0 else t.replace(" ", "\n", 3) for k, t in enumerate(texts)]
    texts += [None, "", "É" * 50, "a\n\na", " lead and trail ", "# | ! 7"]
    docs = docs_of(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(200)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text")
    ensemble = quality.fit(read, spark.read.parquet(str(tmp_path / "labels.parquet")).where(~quality.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in quality.op4_query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and ensemble["rules"]
    for k, text in enumerate(texts):
        stats = brute_statistics(text)
        total = ensemble["bias"] + sum(w * all(low < stats[quality.NAMES[at]] <= high for at, low, high in rule) for w, rule in ensemble["rules"])
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and got[k].predicted == int(got[k].score >= 0.7)


def test_quality_without_labels_rejects_nothing_and_scores_odd_texts(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.keep_good(odd_docs(spark), none).count() == 8
    one_kind = spark.createDataFrame([(1, 1), (6, 1), (None, 0), (3, None), (4, 7)], "doc_id bigint, quality int")
    ensemble = quality.fit(odd_docs(spark), one_kind)
    assert ensemble["rules"] == []
    assert all(0 <= r.score <= 1 for r in quality.score(odd_docs(spark), ensemble).collect())


# 5 ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (left - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixture_meets_targets_and_reruns_agree(spark):
    texts, rng = corpus(seed=9, n=400, size=200)
    sources = ["big"] * 200 + ["mid"] * 120 + [None] * 50 + ["tiny"] * 30
    docs = docs_of(spark, texts, sources)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.md5("text").alias("mark"))
    rows = mixing.pareto_mix(sized).collect()
    again = {(r.doc_id, r.copies) for r in mixing.pareto_mix(sized.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows} and len(rows) == 400
    sizes = Counter()
    for text, source in zip(texts, sources, strict=True):
        sizes[source] += len(text.split())
    wanted = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for source, target in wanted.items():
        gap, whole = target - taken[source], target // sizes[source]
        unused = [r.size for r in rows if r.source == source and r.copies == whole]
        assert 0 <= gap < min(unused, default=10**9) and gap <= 0.01 * target  # what is left out is longer than what is missing


def test_mixture_prefers_documents_of_higher_odds_and_bins_change_nothing(spark, monkeypatch):
    """The share of long and short documents that get the extra copy follows their odds; shares match the order sample's by hand."""
    sized = spark.createDataFrame([(k, "a", 300 if k % 2 else 20, str(k)) for k in range(4000)], "doc_id bigint, source string, size bigint, mark string")
    rows = mixing.pareto_mix(sized, weights=(1,), epochs=0.5).collect()
    long, short = ([r.copies for r in rows if r.size == n] for n in (300, 20))
    assert all(c in (0, 1) for c in long + short)
    p, q = sum(long) / len(long), sum(short) / len(short)
    assert 3.3 < (p / (1 - p)) / (q / (1 - q)) < 4.7  # odds of 4 to 1
    monkeypatch.setattr(mixing, "BINS", 7)
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 10**9)
    assert sorted(mixing.pareto_mix(sized, weights=(1,), epochs=0.5).collect()) == sorted(rows)


def test_mixture_sql_keeps_a_source_without_a_name(spark, tmp_path):
    import duckdb

    texts, _ = corpus(seed=14, n=120, size=90)
    docs_of(spark, texts, [[None, "b", "a"][k % 3] for k in range(120)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.op5_query(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.OP5_SQL})").fetchall()
    assert got == sorted(want)


@pytest.mark.parametrize("first", [0, 1000, 2000])
def test_mixture_query_comes_near_a_target_that_one_document_dominates(spark, tmp_path, first):
    import duckdb

    texts = ["word " * 20_000] + ["word " * 50] * 400 + ["word " * 90] * 300
    rows = [(first + k, t, "en", "a" if k < 401 else "b", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.op5_query(spark, str(tmp_path)).collect()]
    assert abs(sum(r[-1] for r in got if r[2] == 40_000) - next(r[3] for r in got if r[2] == 40_000)) <= 50
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.OP5_SQL})").fetchall())


def brute_mix(rows):
    """Copies by (doc_id) of (doc_id, text, source) rows with ids of their own, by the module's text in plain loops."""
    space, copies = re.compile("[^\\x20\\x09-\\x0D]+"), {}
    sized = [(k, s, len(space.findall(t or "")), hashlib.md5((t or "").encode()).hexdigest()) for k, t, s in rows]
    sizes = Counter()
    for _, source, size, _ in sized:
        sizes[source] += size
    for source, target in brute_targets(dict(sizes)).items():
        wanted = target / sizes[source] if sizes[source] else 0.0
        whole, need, ranked = int(wanted), target - int(wanted) * sizes[source], []
        rest = wanted - whole
        for k, _, size, mark in (r for r in sized if r[1] == source):
            u = (int(hashlib.md5(f"0:{k}:{mark}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            odds = 4 if size >= 200 else 2 if size >= 50 else 1
            ranked.append((u / (1 - u) / (odds * max(rest, 1e-12) / (1 - rest)), k, mark, size, u))
            copies[k] = whole
        if not rest:
            continue
        ranked.sort()
        gap, taken, last = need, set(), None

        def cut(pool, gap):
            sums = np.cumsum([r[3] for r in pool])
            return [r for r, total in zip(pool, sums, strict=True) if total <= gap]

        first = cut(ranked, gap)
        taken |= {r[1] for r in first}
        gap -= sum(r[3] for r in first)
        for _ in range(3):
            fits = [(r[3], -r[4], r[1], r[2]) for r in ranked if r[1] not in taken and 0 < r[3] <= gap]
            fits = [f for f in fits if last is None or f < last]
            if not fits:
                break
            last = max(fits)
            taken.add(last[2])
            gap -= last[0]
        while pool := [r for r in ranked if r[1] not in taken and 0 < r[3] <= gap]:
            more = cut(pool, gap)
            taken |= {r[1] for r in more}
            gap -= sum(r[3] for r in more)
        for k in taken:
            copies[k] += 1
    return copies


def test_mixture_takes_what_plain_loops_take(spark):
    texts, _ = corpus(seed=31, n=300, size=320)
    sources = [["x", "y", None, "z"][k % 7 % 4] for k in range(300)]
    docs = docs_of(spark, texts, sources)
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert got == Counter({k: n for k, n in brute_mix(list(zip(range(300), texts, sources, strict=True))).items() if n})


def test_mixture_fills_a_source_beside_one_dominant_document(spark):
    """No document is added twice, none that fits is left, whatever place the long one has in the ranking."""
    sizes = [(s, n) for s in ("a", "b", None) for n in [4_000] + [10] * 150 + [7] * 50]
    sized = spark.createDataFrame([(k, s, n, str(k)) for k, (s, n) in enumerate(sizes)], "doc_id bigint, source string, size bigint, mark string")
    for seed in range(2):
        rows = mixing.pareto_mix(sized, weights=(1,), epochs=0.5, seed=seed).collect()
        assert len(rows) == len(sizes)
        for source in ("a", "b", None):
            mine = [r for r in rows if r.source == source]
            gap = mine[0].target - sum(r.copies * r.size for r in mine)
            assert gap >= 0 and not [r for r in mine if r.copies == 0 and r.size <= gap]
            assert sum(r.copies for r in mine if r.size < 100) == 200  # all the short ones: 1,850 of 2,925 words


def test_mixture_of_odd_rows_repeats_documents(spark):
    docs = odd_docs(spark).withColumn("mix_id", F.lit(1))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert max(Counter(r.doc_id for r in mixed.collect() if r.doc_id != 1).values()) <= 2
    assert mixing.mix(docs.limit(0)).count() == 0


# 6 and 8 ------------------------------------------------------------------------------------------------------

MULTI = ["don't STOP it's 3½ naïve", "Ünïcode déjà-vu 日本語", "<|endoftext|> as text", "a \x1c b\xa0c", "Σας İstanbul", "", None, "x" * 3000]


def test_encoder_gives_the_librarys_ids():
    from tokenizers import Tokenizer

    texts, _ = corpus(seed=2, n=20)
    plain = Tokenizer.from_file(token_output.default_tokenizer())
    encoder = token_output.Encoder(token_output.default_tokenizer())
    for text in [*texts, *MULTI]:
        assert encoder.encode(text).tolist() == plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24, 31, 32])
def test_packing_is_an_exact_round_trip_with_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 130, 64)]
    packed = token_output.PackedFile(token_output.file_bytes([9, None, 7, -(2**63), 5], ids, bits, block=32))
    flat = np.concatenate(ids)
    assert packed.doc_ids == [9, None, 7, -(2**63), 5]
    for first, last in ((0, len(flat)), (3, 4), (31, 97), (200, 200)):
        assert packed.ids(first, last).tolist() == flat[first:last].tolist()


def test_token_files_hold_every_document_in_order(spark):
    from tallyspark.functions.lineage import new_folder
    from tokenizers import Tokenizer

    texts, _ = corpus(seed=4, n=30)
    texts += MULTI
    docs = docs_of(spark, texts).repartition(5)
    manifest = token_output.write_tokens(docs, new_folder(spark, "t"), file_ids=500)
    assert manifest.count() > 4
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_tokens(spark, manifest).collect()}
    plain, start, want = Tokenizer.from_file(token_output.default_tokenizer()), 0, {}
    for k, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_token_files_of_odd_and_empty_tables(spark):
    from tallyspark.functions.lineage import new_folder

    rows = token_output.read_tokens(spark, token_output.write_tokens(odd_docs(spark), new_folder(spark, "t"))).collect()
    assert len(rows) == 8 and max(rows, key=lambda r: r.start).doc_id is None
    empty = token_output.write_tokens(odd_docs(spark).limit(0), new_folder(spark, "t"))
    assert token_output.read_tokens(spark, empty).count() == 0


def test_separator_scan_counts_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    files, want = [], {}
    for k, closed in enumerate((True, False, True)):
        lengths = rng.integers(1, 40, 30).tolist() + [0]
        ids = np.concatenate([np.append(rng.integers(2, 99, n), 7) for n in lengths]).astype("<u2")
        ids = ids if closed else ids[:-1]
        if k == 2:
            ids = np.array([7, 7, 5, 7], "<u2")
            lengths = [0, 0, 1]
        (tmp_path / f"f{k}").write_bytes(ids.tobytes())
        files.append((str(tmp_path / f"f{k}"), len(ids)))
        starts = np.concatenate([[0], np.flatnonzero(ids == 7) + 1]).tolist()
        spans = [(a, b - a) for a, b in zip(starts, starts[1:], strict=False)] + ([(starts[-1], len(ids) - starts[-1])] if starts[-1] < len(ids) else [])
        want |= {(files[-1][0], i): s for i, s in enumerate(spans)}
    (tmp_path / "empty").write_bytes(b"")
    table = spark.createDataFrame([*files, (str(tmp_path / "empty"), 0)], "path string, file_ids bigint")
    for block in (5, 64, 1 << 20):
        got = token_counts.count_tokens(spark, table, end_id=7, block_ids=block).collect()
        assert {(r.path, r.ordinal): (r.start, r.n_tokens) for r in got} == want


# 7 ------------------------------------------------------------------------------------------------------------


def test_shards_are_exact_gapless_and_repeatable(spark):
    rows = spark.range(1003).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("size"))
    got = sharding.shard(rows, ["doc_id", "size"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r.slot)
    assert sorted(map(len, by.values())) == [41] * 5 + [42] * 19
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(r.doc_id for r in got) == list(range(1003))
    few = sharding.shard(odd_docs(spark).select("doc_id", "n_chars"), ["doc_id", "n_chars"]).collect()
    assert len(few) == 8 and len({r["shard"] for r in few}) == 8
    assert sharding.shard(rows.limit(0), ["doc_id", "size"]).count() == 0
    clash = rows.withColumns({c: F.lit(7) for c in ("sender_0", "first", "second", "bin_0", "place", "local_0", "of_sender", "upto", "offset")})
    named = sharding.shard(clash, ["doc_id", "size"])
    assert named.columns == [*clash.columns, "shard", "slot"]
    assert all(r.place == 7 and r.bin_0 == 7 for r in named.collect())


def test_shards_in_many_bins_are_the_same_as_in_one_order(spark, monkeypatch):
    rows = spark.range(2000).select(F.col("id").alias("doc_id")).coalesce(2)
    whole = {r.doc_id: (r["shard"], r.slot) for r in sharding.shard(rows, ["doc_id"], shards=5, blocks=2).collect()}
    monkeypatch.setattr(sharding, "ROWS_A_BIN", 50)
    binned = sharding.shard(rows, ["doc_id"], shards=5, blocks=2).collect()
    by = defaultdict(list)
    for r in binned:
        by[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(400)) for s in by.values()) and len(by) == 5 and len(whole) == 2000
    # every row is about as likely in any shard: no shard takes its rows from one part of the ids
    assert all(abs(sum(r.doc_id for r in binned if r["shard"] == k) / 400 - 1000) < 150 for k in range(5))


def test_equal_rows_are_dealt_to_all_shards_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BIN", 100)
    rows = spark.range(1200).select(F.when(F.col("id") >= 600, F.col("id")).otherwise(0).alias("doc_id"), F.lit(8).alias("size")).coalesce(2)
    got = sharding.shard(rows, ["doc_id", "size"]).collect()
    equal = Counter(r["shard"] for r in got if r.doc_id == 0)
    assert len(equal) == 24 and all(10 <= n <= 40 for n in equal.values()) and equal.total() == 600
    slots = [r.slot for r in got if r.doc_id == 0]
    assert 20 < sum(slots) / 600 < 29 and all(sorted(r.slot for r in got if r["shard"] == k) == list(range(50)) for k in range(24))


def test_sharding_query_against_the_texts(spark, tmp_path):
    texts, _ = corpus(seed=30, n=70)
    texts += ["é" * 5, "", None]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op7_query(spark, str(tmp_path)).collect()
    sizes = {k: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in enumerate(texts)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == sizes and all(r.law == "rows" and r.grown_shard is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {len(s) for s in by.values()} <= {len(texts) // 24, len(texts) // 24 + 1}


def test_communication_matrix_has_its_margins_and_law():
    rng = random.Random(1)
    matrix = sharding.communication_matrix([10, 0, 7, 3], [5, 5, 6, 4], rng)
    assert [sum(r) for r in matrix] == [10, 0, 7, 3] and [sum(c) for c in zip(*matrix, strict=True)] == [5, 5, 6, 4]
    draws = Counter(sharding.hypergeometric(6, 14, 5, rng) for _ in range(20_000))
    from math import comb

    for k in range(6):
        assert draws[k] / 20_000 == pytest.approx(comb(6, k) * comb(14, 5 - k) / comb(20, 5), abs=0.012)
    big = [sharding.hypergeometric(10**10, 3 * 10**10, 4 * 10**6, rng) for _ in range(50)]
    assert abs(sum(big) / 50 - 10**6) < 1500
    from math import lgamma

    law = [(sum(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) for n, k in ((4000, x), (6000, 5000 - x))), x) for x in range(1800, 2200)]
    top = max(law)[0]
    from math import exp

    mass = {x: exp(w - top) for w, x in law}
    total, drawn = sum(mass.values()), [sharding.hypergeometric(4000, 6000, 5000, rng) for _ in range(20_000)]  # by rejection
    for cut in (1960, 1985, 2000, 2015, 2040):
        assert sum(x <= cut for x in drawn) / 20_000 == pytest.approx(sum(m for x, m in mass.items() if x <= cut) / total, abs=0.012)
    assert sharding.hypergeometric(10**11, 10**12, 3 * 10**10, rng) // 10**8 in (27, 26)


# 9 ------------------------------------------------------------------------------------------------------------


def brute_likeness(a, b):
    pieces = [Counter(p for line in t.splitlines(keepends=True) for p in [*merkle.PIECE.findall(line.rstrip("\n")), *(["\n"] if line.endswith("\n") else [])]) for t in (a, b)]
    size = sum(len(p) * n for p, n in (pieces[0] + pieces[1]).items())
    return 2 * sum(len(p) * n for p, n in (pieces[0] & pieces[1]).items()) / size if size else 1.0


def test_fingerprints_follow_equality_and_edits(spark):
    texts, rng = corpus(seed=6, n=40, size=300)
    texts = [re.sub(" ", lambda m: rng.choice([" ", " ", " ", ". ", "\n"]), t) for t in texts]
    texts += [texts[0], None, "", "ab"]
    got = {r.doc_id: r for r in merkle.compare_with_next(docs_of(spark, texts).repartition(6)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for k, text in enumerate(texts):
        text, following = text or "", texts[(k + 1) % len(texts)] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + following[:cut]
        row = got[k]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert row.fingerprint == merkle.fingerprint(text)[0].hex() and row.edited_fingerprint == merkle.fingerprint(new)[0].hex()
        assert bytes(row.tree) == merkle.fingerprint(text)[1]
        assert row.near_edited == pytest.approx(brute_likeness(text, new)) and row.near_next == pytest.approx(brute_likeness(text, following))
        assert (row.fingerprint == row.edited_fingerprint) == (text == new)
        if len(text) > 300:
            assert 0.5 < row.near_edited < 0.95 and row.near_next < 0.2
    assert got[0].fingerprint == got[40].fingerprint
    assert merkle.compare_with_next(odd_docs(spark)).count() == 8
    assert merkle.compare_with_next(odd_docs(spark).limit(0)).count() == 0


def test_locate_edits_names_the_changed_paragraph():
    old = "\n".join(f"paragraph number {k} says something" for k in range(40))
    new = old.replace("number 17 says", "number 17 denies")
    trees = [merkle.fingerprint(t)[1] for t in (old, new)]
    found = merkle.locate_edits(*trees)
    paragraphs = [(i, j) for i, section in enumerate(merkle.sections_of(trees[1])) for j, _ in enumerate(section)]
    assert len(found) == 1 and paragraphs.index(found[0]) == 17
    assert merkle.locate_edits(trees[0], trees[0]) == [] and 0.9 < merkle.likeness(*trees) < 1
    assert merkle.fingerprint("?" * 1000 + "." * 90 + "x" * 500)[0] != merkle.fingerprint("?" * 1001 + "." * 89 + "x" * 500)[0]


BIG = 2**60


def big_ids(spark, texts):
    """Neighbouring ids that a floating number can't tell apart, with a null id among them, in one batch."""
    rows = [(BIG + k, t) for k, t in enumerate(texts)] + [(None, "the text without an id"), (-(2**63), "the smallest id of all")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)


def test_large_ids_beside_a_null_are_kept_exactly(spark):
    from tallyspark.functions.lineage import new_folder

    texts, _ = corpus(seed=21, n=6)
    docs = big_ids(spark, texts)
    want = {BIG + k: t for k, t in enumerate(texts)} | {None: "the text without an id", -(2**63): "the smallest id of all"}
    got = {r.doc_id: r for r in merkle.compare_with_next(docs).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: merkle.fingerprint(t)[0].hex() for k, t in want.items()}
    assert {r.doc_id: r.fingerprint for r in merkle.fingerprints(docs).collect()} == {k: r.fingerprint for k, r in got.items()}
    encoder = token_output.Encoder(token_output.default_tokenizer())
    packed = token_output.read_tokens(spark, token_output.write_tokens(docs, new_folder(spark, "t"))).collect()
    assert {r.doc_id: r.n_tokens for r in packed} == {k: len(encoder.encode(t)) + 1 for k, t in want.items()}
    manifest = token_counts.write_flat(docs, new_folder(spark, "f"))
    counted = token_counts.count_tokens(spark, manifest.groupBy("path").agg(F.first("file_ids").alias("file_ids")))
    flat = {r.doc_id: r.n_tokens for r in counted.join(manifest.drop("file_ids"), ["path", "ordinal"]).collect()}
    assert flat == {k: len(encoder.encode(t)) + 1 for k, t in want.items()}
    found = near_dedup.near_duplicate_classes(docs).collect()
    assert {r.doc_id for r in found} == set(want) and all(r.class_id == r.doc_id for r in found)


def test_flat_files_refuse_a_width_that_is_too_small():
    assert token_counts.id_type() == "<u2" and token_counts.id_type(end_id=1 << 20) == "<u4"
    with pytest.raises(ValueError):
        token_counts.id_type(dtype="<u1")


def test_token_count_query_counts_every_document(spark, tmp_path):
    texts, _ = corpus(seed=22, n=20)
    docs_of(spark, [*texts, None, "", "<|endoftext|> as text"]).write.parquet(str(tmp_path / "documents.parquet"))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_output.default_tokenizer())
    plain.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in token_counts.op6_query(spark, str(tmp_path)).collect()}
    assert got == {k: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in enumerate([*texts, None, "", "<|endoftext|> as text"])}

# 10 -----------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    space = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(space))
    owner = {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owner.setdefault(key(line), doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == doc_id]
        drop = [k for k, x in enumerate(lines) if len(key(x)) >= 10 and owner[key(x)] != doc_id]
        bits = ",".join(f"{w}:{sum(1 << k % 63 for k in drop if k // 63 == w)}" for w in sorted({k // 63 for k in drop}))
        out[doc_id] = (len(lines), len(drop), hashlib.sha256("\n".join(kept).encode()).hexdigest(), bits)
    return out


@pytest.mark.parametrize("heavy", [256, 4])
def test_line_dedup_matches_brute_force(spark, tmp_path, heavy, monkeypatch):
    rng = random.Random(8)
    pool = [f"Shared line number {k} É" if k % 2 else f"  sHARED Line {k}\t" for k in range(12)] + ["short", "", "common boilerplate line"]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {k} {i} here" for i in range(rng.randint(0, 90))) for k in range(60)]
    rows = [*enumerate(texts), (60, None), (61, ""), (62, "\n".join(["common boilerplate line"] * 200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(line_dedup, "partitions_of", lambda session: heavy)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256, r.dropped_bits) for r in line_dedup.op10_query(spark, str(tmp_path)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_of_odd_rows(spark):
    docs = odd_docs(spark).withColumn("of_id", F.lit(1))
    found = line_dedup.with_bitmaps(docs)
    assert found.count() == 8
    assert [r.dropped[0].bits for r in found.where("doc_id = 6").collect()] == [1]
    assert line_dedup.drop_bitmaps(docs.limit(0)).count() == 0


# pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages_match_plain_loops(spark, tmp_path):
    import corpus_pipeline

    texts, rng = corpus(seed=12, n=160, size=120)
    texts[40] = edited(texts[10], rng, 1)
    item = " ".join(LONG[:14])
    texts[50] += " " + item
    texts = [" ".join(w + "###" for w in t.split()) if 100 <= k < 130 else t for k, t in enumerate(texts)]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, int(not 100 <= k < 130), 0) for k in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(docs.columns) == sorted(SCHEMA.replace(",", "").split()[::2])
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    everyone = set(range(160))
    assert kept[0] == everyone - set(range(100, 130)) and kept[1] == kept[0] - {40} and kept[2] == kept[1] - {50}
    wanted = brute_mix([(k, texts[k], f"s{k % 3}") for k in sorted(kept[2])])
    copies = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert copies == Counter({k: n for k, n in wanted.items() if n})
    from tokenizers import Tokenizer

    plain, start, tokens = Tokenizer.from_file(token_output.default_tokenizer()), 0, []
    for k in sorted(copies.elements()):
        ids = plain.encode(texts[k], add_special_tokens=False).ids + [1]
        tokens.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == tokens
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == tokens
