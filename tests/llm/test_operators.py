"""The training-data operators against brute force, exact round trips and held-out accuracy, on fixtures with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import bpe, embeddings, langid, packing, queries, secrets, simhash, substring_dedup, tokenfile, toxicity, weighted_sampling
from gristmill.llm.common import connected_components

WORDS = [a + b + c for a in ("lor", "vel", "tan", "mir", "gos") for b in ("em", "ip", "un") for c in ("ar", "is", "ok", "e")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(1, 9000)
    shared = prose(2, 90)
    texts = [prose(3, 200), prose(3, 200), prose(3, 199) + " zzz", "", None, long, prose(4, 60) + " " + shared + " " + prose(5, 60), prose(6, 40) + " " + shared + " " + prose(7, 70), "<|endoftext|> é\U0001f600 \n\n  x", "  "]
    rows = [(i, t, "en", "web", 0, 1, 2) for i, t in enumerate(texts)] + [(3, "again", None, None, None, 1, 2), (None, prose(3, 200), None, None, None, 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, bucket int").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)]
    top = {i: i for i in range(600)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    nodes = spark.range(600).withColumnRenamed("id", "node")
    got = {x.node: x.root for x in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in range(600)}


def brute_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    fps = [(r.doc_id, brute_simhash(r.text)) for r in rows]
    top = list(range(len(fps)))
    for _ in fps:
        for i, j in itertools.combinations(range(len(fps)), 2):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                top[i] = top[j] = min(top[i], top[j])
    want = sorted((str(d), f, min((fps[k][0] for k in range(len(fps)) if top[k] == top[i] and fps[k][0] is not None), default=None)) for i, (d, f) in enumerate(fps))
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 3, 5, 6, 7} and 1 not in {r.doc_id for r in kept.collect()}
    assert simhash.near_duplicates(nothing).count() == 0


def test_bk_trees_find_every_link(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(40)]
    values = list({b ^ (1 << r.randrange(64) if k else 0) ^ (1 << r.randrange(64) if k > 1 else 0) for b in base for k in (0, 0, 1, 1, 2, 2, 2)} | {(0xABCD << 48) | (x << 16) for x in range(300)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = connected_components(fps.select(F.col("fp").alias("node")), simhash.near_edges(fps, chunk=64))
    got = {x.node: x.root for x in roots.collect()}
    top = {v: v for v in signed}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in signed}


def expected_ids(text, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(docs, nothing):
    pieces = packing.pack(docs).collect()
    by_doc, used = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for seq in used.values():
        seq.sort()
        assert [o for o, _ in seq] == [0, *itertools.accumulate(n for _, n in seq)][:-1] and sum(n for _, n in seq) <= 2048
    for r in docs.select("doc_id", "text").collect():
        want = expected_ids(r.text, "byte_bpe_50k.json")
        found = sorted(by_doc[r.doc_id, len(want)])
        assert sum(len(x) for _, x in found) % len(want) == 0 and [i for _, x in found for i in x][: len(want)] == want or r.doc_id is None
    total = sum(p.length for p in pieces)
    assert len(used) <= total / 2048 + 2
    assert packing.pack(nothing).count() == 0


def test_patterns_place_every_length():
    r = random.Random(2)
    histogram = {r.randrange(1, 2048): r.randrange(1, 500) for _ in range(300)} | {5: 100_000}
    patterns = packing.plan_patterns(histogram)
    placed = {}
    for pattern, n in patterns:
        assert sum(pattern) <= 2048
        for x in pattern:
            placed[x] = placed.get(x, 0) + n
    assert placed == histogram
    slots, seen = packing.Slots(patterns), {}
    for length, n in [(5, 2000), *[(x, k) for x, k in histogram.items() if x != 5]]:
        for rank in range(min(n, 2000)):
            seq, at = slots.place(length, rank)
            seen.setdefault(seq, []).append((at, at + length))
    assert all(b <= c for spans in seen.values() for (_, b), (c, _) in itertools.pairwise(sorted(spans)))


def test_token_files(docs, nothing):
    got = sorted(tokenfile.token_files(docs).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = expected_ids(r.text, "word_bpe_49k.json")
        assert (g.doc_id, g.start, g.n_tokens, np.frombuffer(g.ids, "<u4").tolist()) == (r.doc_id, start, len(ids), ids)
        start += len(ids)
    assert tokenfile.token_files(nothing).count() == 0


def test_elias_fano():
    r = random.Random(3)
    for n in (0, 1, 2, 255, 256, 1000):
        values = list(itertools.accumulate(r.choice((0, 1, 50, 10_000)) for _ in range(n)))
        ef = tokenfile.EliasFano.unpack(tokenfile.EliasFano.of(values).pack())
        assert ef.window(0, n).tolist() == values and [ef.select(i) for i in range(n)] == values
        for _ in range(20):
            a, b = sorted((r.randrange(n + 1), r.randrange(n + 1)))
            assert ef.window(a, b).tolist() == values[a:b]


def test_byte_bpe(spark, docs, nothing, monkeypatch):
    enc = bpe.encoding("byte_bpe_50k.tiktoken")
    want = {(r.doc_id, r.text or ""): enc.encode_ordinary(r.text or "") for r in docs.select("doc_id", "text").collect()}
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert want[r.doc_id, bytes(r.decoded).decode()] == r.ids
    for text in (prose(8, 500), "a  b\n\n c's 12 !!" * 200, "x" * 3000, "　 a  b " * 300):
        assert [i for p in bpe.parts(text, 50) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text) and "".join(bpe.parts(text, 50)) == text
    assert bpe.decode(bpe.encode(nothing)).count() == 0 and isinstance(enc, tiktoken.Encoding)


def test_weighted_sampling(docs, nothing):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = sorted(weighted_sampling.fingerprints_with_edits(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    by_id = {}
    for i, r in enumerate(rows):
        text, nxt = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        by_id.setdefault((r.doc_id, len(text)), set()).add(hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest())
    assert len(got) == len(rows) and all(g.edited_sha256 in by_id[g.doc_id, g.n_chars] for g in got)
    of = weighted_sampling.fingerprint
    for i, g in enumerate(got):
        text, nxt = rows[i].text or "", rows[(i + 1) % len(rows)].text or ""
        if [(r.doc_id, len(r.text or "")) for r in rows].count((g.doc_id, g.n_chars)) == 1 and g.doc_id != rows[(i + 1) % len(rows)].doc_id:
            new = weighted_sampling.edited(text, nxt)
            assert (g.fingerprint, g.edited_fingerprint, g.near_edited, g.near_next) == (of(text), of(new), weighted_sampling.likeness(of(text), of(new)), weighted_sampling.likeness(of(text), of(nxt)))
    prints = {g.doc_id: g.fingerprint for g in got if g.doc_id is not None and g.doc_id < 3}
    assert prints[0] == prints[1] and weighted_sampling.likeness(prints[0], prints[2]) > 0.8
    assert weighted_sampling.fingerprints_with_edits(nothing).count() == 0


def test_long_unlike_texts_share_no_samples():
    a, b = (" ".join(f"{k}{i}" for i in range(20_000)) for k in "ab")
    assert weighted_sampling.likeness(weighted_sampling.fingerprint(a), weighted_sampling.fingerprint(b)) < 0.02
    # No size of a word or a text changes the rule; a memory that starts anew changes nothing.
    unspaced = "".join(random.Random(5).choice("abcdefgh") for _ in range(90_000))
    half = weighted_sampling.likeness(weighted_sampling.fingerprint(unspaced), weighted_sampling.fingerprint(unspaced[:60_000]))
    assert 0.5 < half < 0.85 and weighted_sampling.Sampler().fingerprint(a) == weighted_sampling.fingerprint(a)


def test_weights_count(monkeypatch):
    """The collision rate is that of the generalised Jaccard similarity by brute force, also where words repeat."""
    errors = []
    for seed in range(40):
        rng = random.Random(seed)
        a, b = ([w for i in range(80) for w in [f"t{seed}x{i}"] * rng.choice((0, 1, 1, 3, 9))] for _ in range(2))
        x, y = weighted_sampling.term_weights(" ".join(a)), weighted_sampling.term_weights(" ".join(b))
        exact = sum(min(x.get(t, 0), y.get(t, 0)) for t in x | y) / sum(max(x.get(t, 0), y.get(t, 0)) for t in x | y)
        errors.append(weighted_sampling.likeness(weighted_sampling.fingerprint(" ".join(a)), weighted_sampling.fingerprint(" ".join(b))) - exact)
    assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.1


def test_collision_rate_is_jaccard():
    for share in (0.2, 0.5, 0.8):
        a, b = [], []
        errors = []
        for seed in range(12):
            common = [f"c{seed}x{i}" for i in range(int(300 * share))]
            own = lambda k: [f"{k}{seed}x{i}" for i in range(300 - int(300 * share))]  # noqa: B023, E731
            a, b = common + own("a"), common + own("b")
            errors.append(weighted_sampling.likeness(weighted_sampling.fingerprint(" ".join(a)), weighted_sampling.fingerprint(" ".join(b))) - len(common) / (600 - len(common)))
        assert abs(np.mean(errors)) < 0.06


def test_substring_dedup(spark, docs, nothing):
    spans = [(r.doc_id, r.start, r.end, r.first_doc_id) for r in substring_dedup.repeated_spans(docs).where("doc_id IS NOT NULL").collect()]
    text = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL AND text <> 'again'").select("doc_id", "text").collect()}
    shared = prose(2, 90)
    hit = [s for s in spans if s[0] == 7]
    assert {s[0] for s in spans} == {1, 2, 7} and {s[3] for s in hit} == {6}
    at = text[7].index(shared)
    assert all(at - 1 <= s[1] and s[2] <= at + len(shared) + 1 for s in hit) and sum(s[2] - s[1] for s in hit) > 0.7 * len(shared)
    cut = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs).where("doc_id IS NOT NULL AND coalesce(text, '') <> 'again'").collect()}
    assert cut[0] == text[0] and cut[6] == text[6] and cut[5] == text[5] and cut[4] is None and len(cut[1]) < 40 and shared not in cut[7]
    assert substring_dedup.drop_repeats(docs).columns == docs.columns and substring_dedup.drop_repeats(docs).count() == docs.count()
    assert substring_dedup.repeated_spans(nothing).count() == 0


def test_chunks_of_texts_without_spaces(spark):
    rng = random.Random(8)
    sign = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    passage, tail = sign(600), "".join(rng.choice("abcdef0123456789+/") for _ in range(3000))
    rows = [(0, sign(400) + passage + sign(300)), (1, sign(417) + passage + sign(200)), (2, tail), (3, "x" + tail[:1000] + "QQ" + tail[1000:]), (4, "la" * 2000), (5, sign(500))]
    spans = [tuple(r)[:1] + tuple(r)[2:4] for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    covered = {d: sum(e - s for x, s, e in spans if x == d) for d in range(6)}
    assert covered[1] > 0.7 * 600 and covered[3] > 0.8 * 3000 and not covered[0] and not covered[2] and not covered[5]
    # An insertion moves no cut but those around it.
    a, b = (t.encode() for t in (tail, tail[:1500] + "inserted" + tail[1500:]))
    (_, x, *_), (_, y, *_) = substring_dedup.chunk_texts([a, b])
    assert len(x) > 40 and len(set(x.tolist()) ^ {e if e < 1500 else e - 8 for e in y.tolist()}) <= 4


def test_embeddings(spark):
    r = np.random.Generator(np.random.PCG64(4))
    centres = r.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + r.standard_normal(24) * (0.12 if i % 3 else 0.4)).tolist(), i % 2) for i in range(700)]
    rows += [(800, None, 1), (801, [0.0] * 24, 1), (802, [float("nan")] * 24, 1), (803, rows[0][1], None), (804, rows[0][1], 0), (805, rows[0][1], 0), (806, [None] * 24, 0), (807, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(v), l) for i, v, l in rows if l is not None and v and all(x is not None for x in v) and np.isfinite(v).all() and any(v)]
    links, top = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, u, a), (j, v, b) in itertools.combinations(good, 2):
        if a == b and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            top[max(x, y)] = min(x, y)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    recall = sum(g[0] for g in got.values()) / sum(links.values())
    assert recall >= 0.9 and all(got[i][0] <= links[i] for i in links)
    assert np.mean([got[i][1] == find(i) for i in links]) > 0.9 and all(g[2] == (g[1] == i) for i, g in got.items())
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_forest_recall(spark):
    """Links and components of thousands of vectors a label, with a dense group, by brute force; columns that clash are not read."""
    r = np.random.Generator(np.random.PCG64(6))
    label = np.repeat([0, 1], 4000)
    centres = r.standard_normal((1300, 32))
    v = centres[r.integers(0, 1300, 8000)] + r.standard_normal((8000, 32)) * r.choice((0.1, 0.22, 0.3), (8000, 1))
    v[:1500] = centres[0] + r.standard_normal((1500, 32)) * 0.1
    rows = [(i, x, int(y), 1, 2, 3, 4) for i, (x, y) in enumerate(zip(v.astype(np.float32).tolist(), label, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int, node int, n int, v int")
    unit = v.astype(np.float32).astype(float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    group = np.arange(8000)
    while True:
        least = np.minimum(group, np.where(near, group[None, :], 8000).min(axis=1))
        if (least == group).all():
            break
        group = least
    got = {x.vec_id: x for x in embeddings.near_duplicates(df).collect()}
    found, true = np.array([got[i].n_links for i in range(8000)]), near.sum(axis=1)
    assert (found <= true).all() and found.sum() / true.sum() > 0.97 and found[1500:].sum() / true[1500:].sum() > 0.9
    assert np.mean([got[i].component_id == group[i] for i in range(8000)]) > 0.95


def test_forest_depth_does_not_depend_on_the_sample():
    """Whatever a node's size, rounds end in leaves below twice the leaf size, and every vector comes to one."""
    r = np.random.Generator(np.random.PCG64(7))
    unit = lambda n: (x := r.standard_normal((n, 16))) / np.sqrt((x * x).sum(axis=1, keepdims=True))
    everyone, directions, rounds = unit(60_000), embeddings.Directions(), 0
    at, sizes, copies = {1: np.arange(60_000)}, [], 0
    while at:
        later = {}
        for root, members in at.items():
            sample = members[r.random(len(members)) < embeddings.SAMPLE / len(members)]
            kind, high, low = embeddings.fit(root, everyone[sample], len(members), 0.93, directions)
            row, place = embeddings.descend(root, everyone[members], kind, high, low, directions)
            assert set(row.tolist()) == set(range(len(members)))
            for k in np.unique(place):
                part = members[row[place == k]]
                if kind[k] == embeddings.OPEN:
                    later[embeddings._id(root, int(k))] = part
                else:
                    sizes.append(len(part))
                    copies += len(part)
        at, rounds = later, rounds + 1
    assert max(sizes) < 2 * embeddings.LEAF and rounds >= 2 and copies < 4 * 60_000


def test_secrets(spark, docs, nothing):
    key = hashlib.sha1(b"k").hexdigest()
    df = spark.createDataFrame([(1, f'api_key = "{key}" and more', "src/app"), (2, "internationalisation of establishments", "src/app"), (3, None, None), (4, "", "x"), (5, f'token = "{key}"\n' * 2000, "src/app")], "doc_id long, text string, source string")
    found = secrets.scan(df)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    text = {r.doc_id: r.text for r in df.collect()}
    assert all(text[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate for r in got)
    assert sorted({(r.doc_id, r.is_secret) for r in got}) == [(1, True), (2, False), (5, True)] and sum(r.doc_id == 5 for r in got) == 2000
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    assert key not in masked[1] + masked[5] and masked[2] == text[2] and masked[3] is None
    assert secrets.scan(nothing).count() == 0
    train = secrets.labelled_findings(spark, 6000)
    held = secrets.labelled_findings(spark, 7200).exceptAll(train)
    voted = secrets.scored(held, secrets.train_forest(train))
    assert voted.agg(F.avg((F.col("secret") == F.col("is_secret").cast("int")).cast("double"))).first()[0] > 0.95


def test_secrets_of_all_shapes(spark):
    """What is found and masked in texts that no training text resembles word for word, and what is left alone."""
    key, b64 = hashlib.sha1(b"k").hexdigest(), "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5"
    secret = {
        1: ('password: "p@ss!w0rd#24"', "p@ss!w0rd#24"),
        2: (f"AWS_SECRET_ACCESS_KEY={b64}\n", b64),
        3: (f"see token={b64} here", b64),
        4: ("jwt eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P sent", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"),
        5: ("mysql://root:x7Fq!29zLm@db.internal/shop", "root:x7Fq!29zLm"),
        6: (f'é😀 api_key = "{key}" é', key),
    }
    clean = {7: "The password: please ask the librarian for it", 8: "internationalisation_of_establishments and more", 9: "order 4465758382889437 shipped", 10: f"fixed in commit {key} last week", 11: "", 12: None, 13: "a secret garden: nobody knows"}
    rows = [(i, t, "src/app", "x", 1) for i, (t, _) in secret.items()] + [(i, t, "src/app", "x", 1) for i, t in clean.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, path string, r int")
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    for i, (text, value) in secret.items():
        assert masked[i] == text.replace(value, secrets.MASK), (i, masked[i])
    assert {i: masked[i] for i in clean} == clean
    for r in secrets.scan(df).collect():
        text = secret[r.doc_id][0] if r.doc_id in secret else clean[r.doc_id]
        assert text[r.start : r.start + len(r.candidate)] == r.candidate and text[: r.start].endswith(r.before[-10:])
    assert secrets.mask_secrets(df).columns == df.columns


def test_toxicity(spark, docs, sf_dir):
    d, labels = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/labels.parquet")
    got = queries.op7_toxicity(spark, f"{sf_dir.rsplit('/', 1)[0]}/sf0.01").join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    gains = toxicity.language_model(d)
    model = toxicity.train(d, labels, gains)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.train(docs, labels.limit(0), gains).odds == {}


def test_deobfuscation(spark):
    d = spark.createDataFrame([(1, "the silly wombat saw silly wombats in the silly hills " * 50)], "doc_id long, text string")
    gains = toxicity.language_model(d)
    assert [toxicity.decode(w, gains) for w in ("s1lly", "s-i-l-l-y", "w0mb@t", "w*mbat")] == [["silly"], ["silly"], ["wombat"], ["wombat"]]


def test_langid(spark, docs, sf_dir):
    folder = f"{sf_dir.rsplit('/', 1)[0]}/sf0.01"
    d = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op10_langid(spark, folder).join(d, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    model = langid.train(d)
    rows = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()}
    assert {(4, "und"), (9, "und")} <= rows and len(rows) == docs.count()
    english, german = (d.where(f"lang = '{x}'").orderBy("doc_id").first().text.split()[:150] for x in ("en", "de"))
    mixed = " ".join(english + german)
    spans = langid.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end_word - len(english)) < 15


def test_queries_return_their_contracts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    for name in ("op4_packing", "op5_simhash", "op6_weighted_sampling", "op8_token_files", "op9_byte_bpe", "op10_langid"):
        assert {r.doc_id for r in queries.QUERIES[name](spark, sf_dir).select("doc_id").collect()} == set(text)
    for r in queries.op8_token_files(spark, sf_dir).limit(20).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(expected_ids(text[r.doc_id], "word_bpe_49k.json"), "<u4").tobytes())


def test_pieces_that_end_in_marks_are_asked_once():
    """Words and marks that a batch holds on their own too go to the library once, and ids stay those of whole texts."""
    from gristmill.llm.tokens import Encoder

    texts = ["ab, ab ,", "ab,\n, ab!!! !!!", "a.b. c1? 1?", "é, é", " ,", "", "ab,,, x"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(name)
        asked = []
        ask, e._ask = e._ask, lambda new, asked=asked: (asked.extend(new), ask(new))
        got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)]
        assert got == e._ids(texts)
        assert len(asked) == len(set(asked)) and "ab," not in asked
