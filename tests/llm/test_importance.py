"""Importance resampling against a plain count."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from gristmill.llm import common, importance, queries

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, targets, percent=5):
    def counted(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = counted(x for _, x in rows), counted(targets)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out, able = [], []
    for k, (i, text) in enumerate(rows):
        n, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            able.append(k)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(able[: percent * len(able) // 100], 1):
        out[k][4] = rank
    return sorted(map(str, out))


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"{'Wörd' if k % 3 else 'alpha'}{k}" for k in r.zipf(1.3, n) % 500)


def test_equals_brute_force(spark):
    texts = [text(i, 5 + i % 40) for i in range(300)] + [None, "", " \n--", "a" * 50_000, text(1, 30_000), "One-two,THREE 4 Ää中文\U0001f600 x"]
    rows = list(enumerate(texts)) + [(9, text(9, 44)), (9, text(9, 44)), (None, text(3, 80))] + [(None, text(4, 40))] * 60
    targets = [text(1000 + i, 30) for i in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*x, 1, "a", 0) for x in rows], "doc_id long, text string, rank int, words string, score int").repartition(5)
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(targets)], "item_id long, text string, doc_id string")
    for percent in (5, 50):
        got = importance.resample(docs, target, percent=percent)
        assert got.columns == COLUMNS and {f.dataType.simpleString() for f in got.schema} == {"bigint"}
        assert sorted(str(list(r)) for r in got.collect()) == brute(rows, targets, percent)
    none = importance.resample(docs, target.limit(0)).collect()
    assert sorted(str(list(r)) for r in none) == brute(rows, [])
    assert importance.resample(docs.limit(0), target).count() == 0


def test_blocks_are_the_matrix(spark):
    rows = [(i, text(i, 3 * i)) for i in range(40)] + [(40, None), (41, "one")]
    blocks = importance.matrix(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id")
    total, vector = np.zeros(10000, np.int64), np.arange(10000)
    for row in blocks.collect():
        block = importance.Block(row.asDict())
        for k, i in enumerate(row.doc_ids):
            want = np.bincount(np.array([zlib.crc32(f.encode()) % 10000 for f in features(rows[i][1])[1]], np.int64), minlength=10000)
            assert block.times(vector)[k] == (want * vector).sum() and block.row_sums()[k] == want.sum()
            total += want
    assert (importance.column_sums(blocks) == total).all()


def test_written_blocks_are_read_in_bounded_parts(spark, monkeypatch):
    """Spark's reader takes up to 4,096 rows of a row group at once: all blocks of a partition in one group are its whole matrix in memory."""
    kept = []
    monkeypatch.setattr(importance, "discard", kept.append)
    words = np.array([f"{k:03x}" for k in range(4096)])
    rows = [(i, " ".join(words[np.random.default_rng(i).integers(0, 4096, 300)])) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = importance.resample(docs, docs.limit(3)).agg({"n_features": "sum", "rank": "max"}).first()
    assert out["sum(n_features)"] == 6000 * (300 + 299 + 298) and out["max(rank)"] == 300
    groups = [m.row_group(k).total_byte_size for f in Path(kept[0].written_path.removeprefix("file:")).glob("*.parquet") for m in [pq.read_metadata(f)] for k in range(m.num_row_groups)]
    assert len(groups) > 1 and max(groups) <= 8 << 20


def test_short_batches_end_with_their_jobs(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with common.short_batches(spark, 1 << 20):
        assert spark.conf.get(key) == str(1 << 20)
    assert spark.conf.get(key) == before
    spark.conf.set(key, "3m")
    with common.short_batches(spark, 1 << 20):
        assert spark.conf.get(key) == "3m"
    spark.conf.unset(key)


def test_blocks_of_empty_texts(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(500)], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in importance.resample(docs, docs).where("n_features = 0 AND weight = 0 AND rank IS NULL").collect()) == list(range(500))


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS score", "'x' AS `a.b`").repartition(6)
    got = importance.ranked(df, [df.score.desc(), df.id.asc()], []).collect()
    assert [(r.score, r.id) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))


def test_query(spark, sf_dir):
    def texts(name, key):
        return [(r[key], r.text) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()]

    got = queries.op11_importance(spark, sf_dir)
    assert sorted(str(list(r)) for r in got.collect()) == brute(texts("documents", "doc_id"), [t for _, t in texts("benchmark", "item_id")])
