"""The pipeline on the smallest tables, stage by stage, and its registration."""

import collections
import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from facsimile.llm import mixing, pii, quality, simhash, tokens
from facsimile.llm.common import written

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("k0", F.lit("extra")).cache()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["quality rules", "near duplicates", "personal data", "mixture", "packing"]
    out = {}
    at = docs
    for name, stage in C.STAGES:
        at = out[name] = written(stage(spark, at, SMALL), "test-stage")
        if name != "packing":
            assert at.columns == docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    judged, _ = quality.assess(docs, labels)
    assert ids(out["quality rules"]) == sorted(r.id for r in judged.filter("kept").collect())
    assert 0 < out["quality rules"].count() < docs.count()
    classes = simhash.near_duplicates(out["quality rules"]).collect()
    assert ids(out["near duplicates"]) == sorted({r.component_id for r in classes})
    assert ids(out["personal data"]) == ids(out["near duplicates"])
    found, _ = pii.detect(out["personal data"])
    assert found.filter(F.size("base") > 0).count() == 0
    assert out["personal data"].filter("n_chars != length(text)").count() == 0
    assert set(ids(out["mixture"])) <= set(ids(out["personal data"]))
    pieces = out["packing"].collect()
    docs_in = collections.Counter(ids(out["mixture"]))
    assert {p.doc_id for p in pieces} == set(docs_in)
    tokens = collections.Counter()
    for p in pieces:
        tokens[p.doc_id, p.doc_tokens] += p.length
    assert all(got == size * docs_in[doc] for (doc, size), got in tokens.items())


def test_registered(spark):
    queries = entry.queries()
    assert queries["pipeline"] is C.run
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    assert set(entry.oracle_sql()) <= set(queries)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"


def corpus():
    """Documents with nulls, empty and very long texts, repeats, near copies, junk and personal data."""
    rng = random.Random(12)
    words = "the river of this town and its old bridge were built in a year that nobody here can name with any ease".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) + str(rng.randint(0, 99)) for _ in range(n))
    out = []
    for i in range(70):
        out.append((i * 3, prose(rng.randint(25, 120))))
    out += [(500, prose(9000)), (501, "word " * 6000)]
    for i in range(12):  # near copies: one word more
        out.append((600 + i, out[i * 4][1] + " end"))
    out += [(700, out[0][1]), (700, out[0][1]), (701, None), (702, ""), (None, prose(40)), (None, None), (703, "short text only")]
    out += [(800 + i, " ".join(w + "#$" for w in prose(60).split())) for i in range(20)]
    out += [(900 + i, f"{prose(30)} mail me.{i}@example.com or +1 555 123 {4000 + i} from 10.0.0.{i} {prose(10)}") for i in range(15)]
    out += [(950 + i, f'{prose(30)} token = "{rng.getrandbits(160):040x}" {prose(10)}') for i in range(10)]
    return [(i, t, "en", ["web", "web", "books", None][k % 4], None if t is None else len(t), k) for k, (i, t) in enumerate(out)]


def plain_near(rows):
    """Ids kept: the smallest of each component of fingerprints at most 3 bits apart, all pairs compared."""
    prints = [simhash.fingerprint_of((r.text or "").encode()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r.doc_id)
    return sorted((min((d for d in ids if d is not None), default=None) for ids in groups.values()), key=repr)


def test_stages_against_plain_versions(spark, tmp_path):
    data = corpus()
    labels = [(i, int(not (800 <= (i or 0) < 900))) for i, *_ in data if i is not None and i != 700]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(data, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out, at = {}, docs
    for name, stage in C.STAGES:
        at = out[name] = written(stage(spark, at, str(tmp_path)), "plain-stage")
        assert name == "packing" or at.schema.names == docs.schema.names
    rows = {name: df.collect() for name, df in out.items()}
    by = lambda r: repr((r.doc_id, r.text, r.extra))

    # quality: the base rule in plain Python, the list by its thresholds
    _, rules = quality.assess(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    stats = {r.k0: r.q for r in quality.text_statistics(docs, [F.col("extra")]).collect()}
    caught = lambda q: any(all((q[c.feature] > c.threshold) == c.above for c in rule.conditions) for rule in rules)
    good = [d for d in docs.collect() if not base_failed(d.text) and not caught(stats[d.extra])]
    assert sorted(map(by, rows["quality rules"])) == sorted(map(by, good)) and rules
    assert not {r.doc_id for r in rows["quality rules"]} & set(range(800, 900))

    # near duplicates: all pairs of fingerprints
    kept = rows["near duplicates"]
    assert sorted((r.doc_id for r in kept), key=repr) == plain_near(rows["quality rules"])
    assert len(kept) < len(rows["quality rules"]) and {by(r) for r in kept} <= {by(r) for r in rows["quality rules"]}

    # personal data: planted cases are gone, other texts are as they were
    texts = {r.extra: r.text for r in rows["personal data"]}
    assert set(texts) == {r.extra for r in kept}
    for r in kept:
        new = texts[r.extra]
        if r.doc_id is not None and 900 <= r.doc_id < 950:
            assert "example.com" not in new and "+1 555" not in new and "10.0.0." not in new and all(x in new for x in ("[EMAIL]", "[PHONE]", "[IP]"))
        elif r.doc_id is not None and 950 <= r.doc_id < 990:
            assert 'token = "[SECRET]"' in new
        else:
            assert new == r.text
    assert all(r.n_chars == len(r.text) for r in rows["personal data"])

    # mixture: its SQL over the same rows
    con = duckdb.connect()
    con.register("documents", out["personal data"].toArrow())
    mixed = con.execute(f"SELECT doc_id FROM ({mixing.mix_sql()})").fetchall()
    assert sorted((r.doc_id for r in rows["mixture"]), key=repr) == sorted((r[0] for r in mixed), key=repr)

    # packing: every id once, sequences without gaps, little padding
    model = Tokenizer.from_file(tokens.default_vocabulary())
    model.encode_special_tokens = True
    ids_of = {t: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in {r.text for r in rows["mixture"]}}
    want = collections.Counter((r.doc_id, len(ids_of[r.text])) for r in rows["mixture"])
    places, got = collections.defaultdict(list), collections.Counter()
    known = collections.defaultdict(set)
    for r in rows["mixture"]:
        known[r.doc_id].add(r.text)
    for p in rows["packing"]:
        places[p.sequence_id].append((p.offset, p.length))
        got[p.doc_id, p.doc_tokens] += p.length
        assert any(zlib.crc32(ids_of[t][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for t in known[p.doc_id] if len(ids_of[t]) == p.doc_tokens)
    assert got == {k: n * k[1] for k, n in want.items()}
    total = sum(len(ids_of[r.text]) for r in rows["mixture"])
    assert sorted(places) == list(range(-(-total // 1024)))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024


def base_failed(text):
    """Fewer than 20 words, or over 30 % of them in 8-word windows that occur twice."""
    words = (text or "").split()
    count = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
