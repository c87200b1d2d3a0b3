"""The pipeline against a plain version, and the queries' SQL on the smallest tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from auroraline.llm import quality, queries
from auroraline.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def counts(text):
    """Scores of the controlled rules, and if the base rules fail, counted plainly."""
    w = WORD.findall(text or "")
    n = len(w)
    windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
    times = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    sums = {"symbols": sum(c in "#*$%&|<>" for c in text or ""), "repeats": len(repeated), "dup_lines": len(lines) - len(set(lines)), "word_chars": sum(map(len, w))}
    return {r: x / n if n else 0.0 for r, x in sums.items()}, n < 50 or 100 * len(repeated) > 50 * n


def plain_quality(sf):
    """doc_ids that the quality rules keep, and the cutoffs by stratum and rule: exact sums, one walk after the other."""
    connection = duckdb.connect()
    docs = connection.sql(f"SELECT doc_id, text, coalesce(lang, '') FROM '{sf}/documents.parquet'").fetchall()
    good = {d for (d,) in connection.sql(f"SELECT doc_id FROM '{sf}/labels.parquet' GROUP BY doc_id HAVING min(quality) = 1").fetchall()}
    judged = [(d, lang, *counts(t)) for d, t, lang in docs]
    held = {}
    for d, lang, scores, failed in judged:
        if not failed and d in good:
            held.setdefault(lang, []).append(scores)
    level, risk, found = quality.DELTA / max(1, len(held) * len(quality.RULES)), quality.ALPHA / len(quality.RULES), {}
    for lang, rows in held.items():
        n = len(rows)
        for rule, (_, grid) in quality.RULES.items():
            for cutoff in grid:
                lost = sum(x[rule] > cutoff for x in rows)
                p = math.fsum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(lost + 1)) if lost < n * risk else 1.0
                if p > level:
                    break
                found[lang, rule] = cutoff
    kept = {d for d, lang, scores, failed in judged if not failed and not any(scores[r] > found.get((lang, r), math.inf) for r in scores)}
    return kept, found


def test_quality_rules(spark):
    """The rules' cutoffs and what they keep, on tables that are large enough for cutoffs to be reached."""
    sf = "/root/testdata/sf0.1"
    kept, found = plain_quality(sf)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    feats = quality.features(docs)
    assert {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.cutoffs(feats, labels).collect()} == found and found
    assert {r["doc_id"] for r in quality.keep_documents(docs, labels).select("doc_id").collect()} == kept


def test_pipeline(spark):
    connection = duckdb.connect()
    docs = dict(connection.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())
    kept, _ = plain_quality(SF)
    docs = {d: t for d, t in docs.items() if d in kept}
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(low(t))
        sets[d] = {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    group = {d: d for d in docs}
    for d in docs:
        for e in docs:
            if e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                a, b = group[d], group[e]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    docs = {d: t for d, t in docs.items() if group[d] == d}
    seen, left = set(), {}
    for d, t in sorted(docs.items()):
        w = WORD.findall(t)
        own = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        gone = {i + k for i, x in enumerate(own) if x in seen for k in range(50)}
        seen |= set(own)
        left[d] = [x for i, x in enumerate(w) if i not in gone]
    items = set()
    for (t,) in connection.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        w = LEAK.findall(low(t))
        items |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for d, w in left.items():
        own = LEAK.findall(low(" ".join(w)))
        if not any(tuple(own[i : i + 10]) in items for i in range(len(own) - 9)):
            want[d] = tokenizer.encode(" ".join(w), add_special_tokens=False).ids
    found = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = connection.sql(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(str, result.fetchall()))
