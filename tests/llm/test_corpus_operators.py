"""Every operator against a plain version, on rows with nulls, ties, copies, long and empty texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auroraline.llm import bpe, decontaminate, langid, lm_score, neardup, quality, rollup, substring, tokenstore, toxicity
from auroraline.llm.queries import tokenizer_path

#: Names that operators have for columns of their own, with values that must pass through.
CLASHES = {"n_words int": 7, "n int": 8, "th string": "a", "node string": "b", "items string": "c", "did string": "d", "_did string": "e", "_th int": 9, "row string": "f", "_row string": "g", "starts string": "h", "_starts int": 10, "hit_words string": "i", "component string": "j", "_stratum string": "k", "stratum int": 11, "`a.b` int": 12, "words string": "l", "size string": "m", "least int": 13, "_words int": 14, "key int": 15}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(CLASHES)
BIG = 2**63 - 1


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("an", "th", "er", "Re", "é", "on", "x")) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(300), text(70)
    rows = [(1, base), (2, base), (3, base.upper()), (4, base.replace(" ", "\n", 40))]
    for i in range(5, 15):
        words = base.split(" ")
        for _ in range(rng.randint(1, 25)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(20 + i, f"{text(40)} {passage}  {text(30)}\n{text(20)}") for i in range(12)]
    rows += [(40 + i, text(rng.randint(1, 60))) for i in range(30)]
    rows += [(80, None), (81, ""), (82, "  \n\t "), (83, "one two"), (84, "one two"), (85, "One  TWO"), (86, "single"), (87, text(6000)), (88, "😀 漢字 naïve 'tis it's " * 20)]
    rows += [(None, base), (None, None), (None, text(80)), (20, rows[14][1]), (20, rows[14][1]), (90, "again and again and again " * 30), (91, f"{passage} {passage}")]
    return rows


def rest(doc_id):
    """All columns of a row but its id and text."""
    return (["en", "fr", None][(doc_id or 0) % 3], "s", 0, *CLASHES.values())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *rest(d)) for d, t in corpus()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, rule=WORD):
    return rule.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


ITEMS = [(1, " ".join(words(corpus()[0][1])[100:115])), (2, "one two"), (3, None), (4, ""), (5, "!!"), (6, " ".join(words(corpus()[0][1])[100:115])), (None, "single"), (7, "never seen in any of these texts at all my friend so")]


@pytest.mark.parametrize("block", [400_000, 3])
def test_decontaminate(spark, docs, empty, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for doc_id, text in corpus():
        own, hit, ids = words(lower(text), rule), set(), set()
        for item_id, item in ITEMS:
            w = words(lower(item), rule)
            size = min(10, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                for j in range(len(own) - size + 1):
                    if own[j : j + size] == w[i : i + size]:
                        hit |= set(range(j, j + size))
                        ids |= {item_id} - {None}
        want.append((doc_id, len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    marked = decontaminate.mark(docs, items, block_windows=block)
    assert got(decontaminate.digest(marked)) == sorted(want, key=str)
    assert sum(r[-1] for r in want) > 5
    kept = decontaminate.remove_documents(docs, items, block_windows=block)
    assert kept.columns == docs.columns and got(kept) == sorted(((d, t, *rest(d)) for (d, t), r in zip(corpus(), want, strict=True) if not r[-1]), key=str)
    assert decontaminate.mark(empty, items).count() == 0
    assert decontaminate.remove_documents(docs, items.limit(0)).count() == docs.count()
    left = decontaminate.remove_spans(docs, items, block_windows=block)
    assert decontaminate.mark(left.where("doc_id = 83"), items).select(F.size("hit_words")).first()[0] == 0
    assert {tuple(r)[2:] for r in left.collect()} == {rest(d) for d, _ in corpus()}
    assert decontaminate.remove_spans(empty, items).count() == 0


def test_blocks_are_bounded(spark):
    """Neither a long item nor a window that many items have makes a block larger."""
    long = " ".join(f"w{k}" for k in range(5000))
    items = spark.createDataFrame([(0, long), *[(i, "one two three four five six seven eight nine ten") for i in range(1, 3001)]], "item_id long, text string")
    n, blocks = decontaminate.item_blocks(items, 10, 1000)
    sizes = [sum(len(p[0]) for p in b.parts.values()) for b in blocks]
    assert len(sizes) == n == 8 and sum(sizes) == 4991 + 3000 and max(sizes) < 1200
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten eleven"), (2, long[-40:]), (3, long)], "doc_id long, text string")
    marked = {r["doc_id"]: r for r in decontaminate.mark(docs, items, block_windows=1000).collect()}
    assert marked[1]["items"] == list(range(1, 3001)) and marked[1]["hit_words"] == list(range(1, 11)) and marked[1]["n_words"] == 12
    assert marked[2]["items"] == [] and marked[3]["items"] == [0] and len(marked[3]["hit_words"]) == 5000


def sets(text, width):
    w = words(lower(text))
    return {tuple(w)} - {()} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, width, percent):
    rows = corpus()
    own = [sets(t, width) for _, t in rows]
    component = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                a, b = component[i], component[j]
                component = [b if c == a else c for c in component]
    want = []
    for i, (doc_id, _) in enumerate(rows):
        least = min((BIG if rows[k][0] is None else rows[k][0]) for k in range(len(rows)) if component[k] == component[i])
        mine = BIG if doc_id is None else doc_id
        want.append((doc_id, len(own[i]), None if least == BIG else least, mine == least))
    found = neardup.near_duplicates(docs, width, percent)
    assert got(found.select("doc_id", "n_shingles", "component_id", "kept")) == sorted(want, key=str)
    kept = neardup.drop_near_duplicates(docs, width, percent)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} <= {(d, t, *rest(d)) for d, t in corpus()}
    assert sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted({r[0] for r in want if r[3] and r[0] is not None})
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_crowds_lose_no_link(spark):
    """Many documents share most of their words without being alike; some pairs among them are."""
    rng = random.Random(5)
    common_part = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(60):
        tail = [f"t{i}_{k}" for k in range(60)]
        rows.append((2 * i, " ".join(common_part + tail)))
        near = tail.copy()
        near[rng.randrange(60)] = "other"
        rows.append((2 * i + 1, " ".join(common_part + near)))
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert found == {d: d - d % 2 for d, _ in rows}


def brute_components(rows, width, percent):
    own = [sets(t, width) for _, t in rows]
    component, alike = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                alike += 1
                a, b = component[i], component[j]
                if a != b:
                    component = [min(a, b) if c == max(a, b) else c for c in component]
    return {d: rows[c][0] for (d, _), c in zip(rows, component, strict=True)}, alike


def test_copies_of_one_original_are_one_group(spark):
    """Each copy is like the original, which has an id in the middle, and no two copies need be alike."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1001):
        words = base.copy()
        if i != 500:
            for k in rng.sample(range(2, 198), 5):
                words[k] = f"e{i}_{k}"
        rows.append((i, " ".join(words)))
    want, alike = brute_components(rows, 3, 85)
    assert alike < 100_000 and sum(c == 0 for c in want.values()) > 900
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert found == want


def test_crowd_just_below_the_limit(spark):
    """All pairs are at 0.80 to 0.84 but for some in the middle, which are alike."""
    rng = random.Random(9)
    common_part = [f"c{i}" for i in range(200)]
    tails = [[f"t{i}_{k}" for k in range(22)] for i in range(150)]
    for i in range(40, 110, 2):
        tails[i + 1] = tails[i].copy()
        tails[i + 1][rng.randrange(22)] = f"o{i}"
    rows = [(i, " ".join(common_part + t)) for i, t in enumerate(tails)]
    rng.shuffle(rows)
    want, alike = brute_components(sorted(rows), 3, 85)
    assert alike == 35 and 0.8 < len(sets(rows[0][1], 3) & sets(rows[1][1], 3)) / len(sets(rows[0][1], 3) | sets(rows[1][1], 3)) < 0.85
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert found == want


def test_signatures_agree_with_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**64, 400, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:320], rng.integers(0, 2**64, 80, dtype=np.uint64)]))
    x, y = (neardup.signatures(s, np.array([len(s)]))[0] for s in (a, b))
    assert abs((x == y).mean() - 320 / 480) < 0.12
    one = neardup.signatures(a[:1], np.array([1]))
    assert (one == a[0]).all()
    assert (neardup.signatures(a[:0], np.array([0])) == 0).all()


def test_repeated_spans(docs, empty, monkeypatch):
    rows = corpus()
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, BIG), BIG if doc_id is None else doc_id)
    want, kept_words = [], {}
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (BIG if doc_id is None else doc_id):
                gone |= set(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        kept_words[(doc_id, text)] = kept
        want.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sum(r[2] > 0 for r in want) > 10
    assert got(substring.digest(docs)) == sorted(want, key=str)
    left = substring.remove(docs)
    assert left.columns == docs.columns and substring.remove(empty).count() == 0
    assert sorted(((r[0], *tuple(r)[2:]) for r in left.collect()), key=str) == sorted(((d, *rest(d)) for d, _ in corpus()), key=str)
    by_id = {}
    for r in left.where("doc_id is not null").collect():
        by_id.setdefault(r["doc_id"], set()).add(tuple(words(r["text"])))
    for (doc_id, _), kept in kept_words.items():
        if doc_id is not None:
            assert tuple(kept) in by_id[doc_id]
    assert substring.digest(empty).count() == 0
    monkeypatch.setattr(substring, "SHARD", 1)  # every shared minimiser is dealt anew
    assert got(substring.digest(docs)) == sorted(want, key=str)
    monkeypatch.setattr(substring, "SHARD", 4)  # some are
    assert got(substring.digest(docs)) == sorted(want, key=str)


def test_suffix_automaton():
    rng = random.Random(9)
    for _ in range(60):
        earlier = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for e in earlier:
            automaton.add(e)
        text = [rng.choice("abc") for _ in range(15)]
        has = {tuple(e[i : i + 4]) for e in earlier for i in range(len(e) - 3)}
        assert automaton.matches(text, 4) == [i for i in range(12) if tuple(text[i : i + 4]) in has]


def test_quality_features(docs, empty):
    want = []
    for doc_id, text in corpus():
        w = words(text)
        seen, again = {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                again |= {i + k for i in places for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed))
    found = quality.features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(found) == sorted(want, key=str)
    assert quality.features(empty).count() == 0


def test_quality_without_evidence(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs, none)
    assert judged.where("kept = base_failed").count() == 0 and judged.count() == docs.count()
    assert quality.judge(empty, none).count() == 0
    kept = quality.keep_documents(docs, none)
    passed = {r["doc_id"] for r in judged.where("kept").collect()}
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count()
    assert got(kept) == sorted(((d, t, *rest(d)) for d, t in corpus() if d in passed and (d is not None or t)), key=str)
    assert quality.keep_documents(empty, none).count() == 0


def test_binomial_tail(spark):
    cases = [(10, 0, 0.1), (100, 3, 0.1), (5000, 80, 0.02), (200000, 3800, 0.02), (50, 20, 0.1)]
    for n, k, p in cases:
        exact = 1.0 if k >= n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        found = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
        assert found == pytest.approx(exact, rel=1e-8)


def test_controlled_cutoffs_respect_their_risk(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80)), "en") for i in range(1500)]
    noisy = [(5000 + i, " ".join(f"w{rng.randrange(10**6)}###" for _ in range(80)), "en") for i in range(60)]
    docs = spark.createDataFrame(clean + noisy, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1 if d < 5000 else 0, 0) for d, *_ in clean + noisy], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert all(not r["kept"] for r in rows if r["doc_id"] >= 5000)
    assert sum(not r["kept"] for r in rows if r["doc_id"] < 5000) <= quality.ALPHA * len(clean)


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for doc_id, text in corpus():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    path = tokenizer_path("word_bpe_49k.json")
    assert got(bpe.digest(docs, path)) == sorted(want, key=str)
    both = bpe.decode(bpe.encode(docs, path).withColumnRenamed("decoded", "direct"), path)
    assert both.where("not (direct <=> decoded)").count() == 0
    assert bpe.digest(empty, path).count() == 0


def _odd_texts() -> list[str]:
    rng = random.Random(8)
    parts = "a b's 't it're l'll 'd ' '' \n \t\r  é É ß Σσς İ 12 ٣ 漢字 か゚ ﷺ 😀 <|endoftext|> <|startoftext|> 'S _-— \x1c \x85 Ǆ ﬁ".split(" ")
    return ["", *["".join(rng.choice(parts + [" ", "  "]) for _ in range(rng.randint(1, 25))) for _ in range(800)]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_match_the_library(name):
    from tokenizers import Tokenizer

    texts = _odd_texts()
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    if name.startswith("word"):
        assert [i.tolist() for i, _ in bpe.encoder(tokenizer_path(name)).encode(texts)] == want
    else:
        ids, counts = tokenstore.byte_encoder(tokenizer_path(name)).encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    path = str(tmp_path / "tokens")
    tokenstore.write(docs, tokenizer_path("byte_bpe_50k.json"), path)
    rows = tokenstore.read_digest(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in corpus()), key=lambda d: -1 if d is None else d)
    at, left = 0, [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in corpus()]
    for r in rows:
        match = next(x for x in left if x[0] == r["doc_id"] and zlib.crc32(np.array(x[1], "<u4").tobytes()) == r["ids_crc32"])
        left.remove(match)
        assert (r["start"], r["n_tokens"]) == (at, len(match[1]))
        at += len(match[1])
    assert tokenstore.read_ids(spark, path).selectExpr("sum(size(ids))").first()[0] == at
    tokenstore.write(empty, tokenizer_path("byte_bpe_50k.json"), path)
    assert tokenstore.read_digest(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 59, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 50257, 2**45, 2**64 - 1):
        ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        ids[rng.random(n) < 0.5] %= np.uint64(7)
        words_, per_block, escapes, _ = tokenstore.pack(ids)
        assert (tokenstore.unpack(words_, per_block, escapes, n) == ids).all()


def test_rollup_is_idempotent(spark, docs, tmp_path):
    names = list(rollup.TOKENIZERS)
    counts = rollup.counted(docs)
    ledger = rollup.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("a", rollup.deltas(counts, names)) and not ledger.commit("a", rollup.deltas(counts, names))
    total = {(r["source"], r["lang"]): r["n_tokens"] for r in ledger.totals().where("tokenizer = 'whitespace/1'").collect()}
    assert sum(total.values()) == sum(len(words(t)) for _, t in corpus())
    assert ("s", None) in total
    ledger.commit("b", rollup.deltas(counts, names, -1))
    assert ledger.totals().count() == 0 and ledger.batches() == ["a", "b"]


def test_rollup_takes_revisions_and_recovers(spark, docs, empty, tmp_path):
    """Nulls, repeated rows, a revision, what a failed commit left, two writers of one batch, and a vocabulary file as a version."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    names = [*rollup.TOKENIZERS, "byte_bpe_50k/1"]
    count = lambda d: rollup.counted(d).join(rollup.counted_by_file(d, names[-1], path).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("c"), names[-1]).distinct(), F.expr("doc_id <=> id and n_chars = c"))
    some = docs.where("doc_id is not null and doc_id <> 20")
    old, new = count(some), count(some.where("doc_id < 30").withColumn("text", F.expr("substr(text, 1, 50)")))
    ledger, other = (rollup.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    (tmp_path / "ledger" / "batch=a").mkdir(parents=True)  # without its _SUCCESS
    (tmp_path / "ledger" / "batch=a" / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "ledger" / "_staged-a-x").mkdir()
    assert ledger.batches() == [] and ledger.commit("a", rollup.deltas(old, names))
    assert not other.commit("a", rollup.deltas(old, names))
    revised = rollup.revisions(old.where("doc_id < 30"), new, names)
    assert other.commit("b", revised) and not ledger.commit("b", revised)
    tokenizer = Tokenizer.from_file(path)
    texts = [t[:50] if t and d < 30 else t or "" for d, t in corpus() if d not in (None, 20)]
    totals = {r["tokenizer"]: 0 for r in ledger.totals().collect()}
    for r in ledger.totals().collect():
        totals[r["tokenizer"]] += r["n_tokens"]
    assert totals["whitespace/1"] == sum(len(words(t)) for t in texts) != totals["wordpunct/1"]
    assert totals["byte_bpe_50k/1"] == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts)
    assert rollup.counted_by_file(empty, "x", path).count() == 0
    # a writer that looked before the other one's rename
    seen = iter([False, True, True])
    other.committed = lambda batch: next(seen)
    before = sorted(p.name for p in (tmp_path / "ledger").iterdir())
    assert not other.commit("b", revised) and sorted(p.name for p in (tmp_path / "ledger").iterdir()) == before


def test_language(spark, empty):
    rng = random.Random(4)
    stems = {"en": ("the", "ing", "th", "sh"), "fr": ("eau", "ou", "é", "que"), "de": ("sch", "ung", "ei", "ü")}
    text = lambda lang: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choice(sorted(stems)) for _ in range(400))] + [(9000, None, "en"), (9001, "12 !!", "en"), (None, text("fr"), "fr"), (9002, text("fr") + " 漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.fit_field(docs, 60)
    found = {r["doc_id"]: r for r in langid.predict(docs, field).collect()}
    held = [r for r in rows[:400] if langid.is_held_out(r[0])]
    assert all(found[r[0]]["held_out"] for r in held)
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert found[9000]["lang_pred"] == found[9001]["lang_pred"] == "und" and found[9000]["score"] == 0.0
    assert not found[None]["held_out"] and found[9002]["lang_pred"] == "fr"
    mixed = langid.label_words(field, text("en") + " " + text("de"))
    assert np.mean([w[1] == ("en" if i < 40 else "de") for i, w in enumerate(mixed)]) > 0.9
    assert langid.predict(empty, field).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit_field(empty)).collect()} == {"und"}


def test_language_model_is_bounded(spark, monkeypatch):
    """Very many languages are learned with fewer buckets, not refused."""
    assert langid.buckets_for(4) == langid.BUCKETS and all(langid.buckets_for(k) * k <= langid.WEIGHTS for k in (200, 1000, 50_000))
    monkeypatch.setattr(langid, "WEIGHTS", 1 << 16)
    rows = [(i, " ".join(chr(97 + i % 26) * 2 + chr(97 + (i + k) % 3) for k in range(30)), f"l{i % 26}") for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.fit_field(docs)
    assert field.weights.shape == (2048, 26)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, field).collect()}
    assert np.mean([found[d] == lang for d, _, lang in rows]) > 0.9


def test_language_scores_are_mean_marginals(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("the", "cat", "le", "chat", "der", "hund")) for _ in range(rng.randint(1, 9))), ("en", "fr", "de")[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.fit_field(docs)
    for r in langid.predict(docs, field).collect():
        text = rows[r["doc_id"]][1].encode()
        one = langid.common.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), langid._OUT)
        e, n, k = field.emissions(one), len(one), len(field.langs)
        alpha, beta = np.zeros((n, k)), np.zeros((n, k))
        alpha[0] = e[0]
        for t in range(1, n):
            alpha[t] = [e[t, j] + np.logaddexp.reduce(alpha[t - 1] + field.moves[:, j]) for j in range(k)]
        for t in range(n - 2, -1, -1):
            beta[t] = [np.logaddexp.reduce(field.moves[i] + e[t + 1] + beta[t + 1]) for i in range(k)]
        mean = np.exp(alpha + beta - np.logaddexp.reduce(alpha[-1])).mean(0)
        assert r["lang_pred"] == field.langs[int(mean.argmax())] and r["score"] == pytest.approx(mean.max(), rel=1e-6)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(6)
    field = langid.Field(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)))
    e = rng.normal(size=(9, 3))
    first, size = np.array([0, 4]), np.array([4, 5])
    marginal, pairs = field.forward_backward(e, first, size)
    total = np.zeros((3, 3))
    for a, n in zip(first, size, strict=True):
        weights = {}
        for path in np.ndindex(*[3] * n):
            weights[path] = math.exp(sum(e[a + t, y] for t, y in enumerate(path)) + sum(field.moves[path[t], path[t + 1]] for t in range(n - 1)))
        z = sum(weights.values())
        for t in range(n):
            for y in range(3):
                assert marginal[a + t, y] == pytest.approx(sum(w for p, w in weights.items() if p[t] == y) / z)
        for p, w in weights.items():
            for t in range(n - 1):
                total[p[t], p[t + 1]] += w / z
    assert pairs == pytest.approx(total)


def test_toxicity(spark, empty):
    rng = random.Random(7)
    text = lambda bad: " ".join(rng.choice(("idiot", "trash")) if bad and rng.random() < 0.1 else f"w{rng.randrange(50)}" for _ in range(60))
    rows = [(i, text(i % 4 == 0)) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (200000, 1, 1)], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(docs, toxicity.fit_chain(docs, labels)).collect()}
    assert np.mean([(scored[i] >= 0.5) == (i % 4 == 0) for i in range(200, 400)]) > 0.95
    assert scored[1000] < 0.5 and scored[1001] == scored[1000]
    assert toxicity.score(empty, toxicity.fit_chain(empty, labels)).count() == 0
    # labels of other documents take no place in the sample, and the sample is bounded in bytes
    foreign = labels.unionByName(spark.range(10**6, 10**6 + 5000).selectExpr("id as doc_id", "1 as quality", "1 as toxic"))
    chain = toxicity.fit_chain(docs, foreign, sample=200)
    again = toxicity.fit_chain(docs, labels, sample=200)
    assert (chain.known == again.known).all() and all((a == b).all() for a, b in zip(chain.weights, again.weights, strict=True))
    assert len(toxicity.fit_chain(docs, labels, sample_bytes=1).known) == 0


def test_toxicity_score_is_the_chain(spark):
    """Probabilities word by word from the model's weights."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("Idiot", "trash", "good", "words", "elephant", "é漢")) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("good" in t), int("trash" in t)) for i, t in rows[:100]], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    found = {r["doc_id"]: [r[f"p_{n}"] for n in chain.names] for r in toxicity.score(docs, chain).collect()}
    place = {int(h): k for k, h in enumerate(chain.known)}
    for d, t in rows:
        features = set()
        for w in (t or "").lower().split():
            raw = np.frombuffer(w.encode(), np.uint8)
            one = toxicity.common.Words(raw, np.array([0, len(raw)]), toxicity.SEPARATORS_RAW)
            features |= {int(h) for h in toxicity.feature_hashes(one)[1]} & place.keys()
        logits = []
        for k in range(len(chain.names)):
            logits.append(sum(chain.weights[k][place[h]] for h in features) + chain.biases[k] + sum(x * v for x, v in zip(logits, chain.earlier[k], strict=False)))
        assert found[d] == pytest.approx([1 / (1 + math.exp(-x)) for x in logits], rel=1e-6)


def test_lm_prefers_its_language(spark, empty):
    rng = random.Random(1)
    sentence = lambda: " ".join([*rng.choice((("the", "cat", "sat"), ("a", "dog", "ran"))), rng.choice(("home", "far"))])
    good = [(i, " ".join(sentence() for _ in range(40))) for i in range(3000)]
    shuffled = good[0][1].split()
    rng.shuffle(shuffled)
    rows = [*good, (9000, " ".join(shuffled)), (9001, None), (9002, "")]
    found = {r["doc_id"]: r for r in lm_score.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[9000]["mean_log_probability"] < found[0]["mean_log_probability"] - 0.5
    assert found[9001]["n_tokens"] == 0 and found[9001]["mean_log_probability"] is None and found[9002]["pseudo_log_likelihood"] == 0
    assert lm_score.fit_and_score(empty).count() == 0


def test_lm_charges_words_beyond_the_most_frequent(spark):
    """Clean prose has words beyond the network's, too; those that no other text has are less likely."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(20000 * rng.random() ** 3)}" for _ in range(100))) for i in range(400)]
    rows.append((9000, " ".join(f"x{k}" for k in range(100))))
    found = {r["doc_id"]: r["mean_log_probability"] for r in lm_score.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 401 and found[9000] < min(v for d, v in found.items() if d < 9000)


def test_lm_against_a_plain_version(spark, monkeypatch):
    """Scores word by word, with the whole softmax, from the trained weights; some counts are broadcast and some joined."""
    monkeypatch.setattr(lm_score, "TABLE", 7000)
    rng = random.Random(12)
    rows = [(i, " ".join(f"W{int(9000 * rng.random() ** 2)}" for _ in range(rng.randint(1, 120)))) for i in range(400)] + [(7, "x1 x2"), (8, ""), (9, None)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = lm_score.vocabulary(docs)
    flat = lm_score.train(docs, vocab)
    found = sorted(((r["doc_id"], r["n_tokens"], r["pseudo_log_likelihood"]) for r in lm_score.score(docs, vocab, flat).collect()), key=str)
    counts = {}
    for _, t in rows:
        for w in (t or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    key = {w: int(lm_score.common.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), lm_score.SEPARATORS_RAW).hashes()[0]) for w in counts}
    top = sorted(counts, key=lambda w: (-counts[w], key[w]))[: lm_score.SIZE - 1]
    rank = {w: k for k, w in enumerate(top)}
    rest = sum(n for w, n in counts.items() if w not in rank), sum(w not in rank for w in counts)
    assert len(counts) > len(vocab.known) > lm_score.SIZE and vocab.rest == rest
    net = lm_score.Network(flat)
    vector = lambda w: net.vectors[rank[w] if w in rank else lm_score.SIZE + (key[w] >> 40) % lm_score.RARE]
    edge, want = np.zeros(lm_score.DIM), []
    soft = lambda x: x - np.log(np.exp(x).sum())
    for d, t in rows:
        words_, total = (t or "").lower().split(), 0.0
        n_rest = sum(w not in rank for w in words_)
        for i, w in enumerate(words_):
            near = [vector(words_[i + k]) if 0 <= i + k < len(words_) else edge for k in (-2, -1, 1, 2)]
            h = np.tanh(np.concatenate(near) @ net.w + net.b)
            token = rank.get(w, lm_score.SIZE - 1)
            c, m = divmod(token, lm_score.CLASS)
            total += soft(h @ net.cw + net.cb)[c] + soft(h @ net.mw[c] + net.mb[c])[m]
            if w not in rank:
                total += math.log((counts[w] - words_.count(w) + lm_score.PRIOR) / (rest[0] - n_rest + lm_score.PRIOR * rest[1]))
        want.append((d, len(words_), total))
    want.sort(key=str)
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in want], rel=1e-3, abs=1e-3)


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 4000)
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{int(3000 * rng.random() ** 2)}" for _ in range(60))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r["doc_id"]: r["mean_log_probability"] for r in lm_score.fit_and_score(docs.repartition(n)).collect()} for n in (1, 16))
    assert max(abs(one[d] - many[d]) for d in one) < 1e-4


def test_lm_gradient():
    rng = np.random.default_rng(2)
    near, token = rng.integers(0, lm_score.SIZE + lm_score.RARE, (64, 2 * lm_score.SIDE)), rng.integers(0, lm_score.SIZE, 64)
    net = lm_score.Network.start()
    before = net.log_probability(near, token).mean()
    seen = lm_score.Network()
    for _ in range(20):
        net.step(near, token, seen)
    assert net.log_probability(near, token).mean() > before + 1
    whole = [np.logaddexp.reduce(net.log_probability(np.repeat(near[:1], lm_score.SIZE, 0), np.arange(lm_score.SIZE)))]
    assert whole[0] == pytest.approx(0, abs=1e-3)
