"""Archives, phrases and the manifest against plain versions, round trips and odd tables."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from same import duck_rows, spark_rows

from lumenframe.llm import collocations, common, merkle, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def pages(spark):
    rng = random.Random(3)
    texts = ["", "same", "same", "same", None, "é\u0000\r\n\r\nWARC/1.1\r\n", "long " * 60_000] + ["<p>%d</p>" % rng.randrange(40) for _ in range(300)]
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate(texts)]
    rows[1] = (1, None, "same")
    rows[2] = (2, "http://x/a\r\nb ü", "same")
    return spark.createDataFrame(rows, PAGES).repartition(5)


def test_warc_is_its_sql(spark):
    p = pages(spark).withColumn("rid", F.lit("clash")).withColumn("sha", F.lit(1)).withColumn("offset", F.lit(None).cast("int"))
    frame = p.select("page_id", "html").toPandas()
    frame["html"] = frame["html"].astype(object).where(frame["html"].notna(), None)
    assert spark_rows(warc.round_trip(p)) == duck_rows(warc.SQL, tables={"pages": frame})
    assert warc.round_trip(p.limit(0)).count() == 0


def test_warc_ties_nulls_and_small_payloads(spark):
    rows = [(7, "u", "twice"), (7, "u", "twice"), (7, "v", "twice"), (None, "w", "twice"), (None, None, "alone"), (3, "x", "tiny"), (4, "x", "tiny")]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, PAGES), least=5).select("page_id", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(7, "response", None), (7, "revisit", 7), (7, "revisit", 7), (None, "revisit", 7), (None, "response", None), (3, "response", None), (4, "response", None)], key=str)


def test_archives_are_plain_warc(spark):
    p = pages(spark)
    index = warc.write_archives(p, archive_bytes=4000)
    rows = index.collect()
    want = {r["page_id"]: (r["html"] or "").encode() for r in p.collect()}
    seen = Counter()
    for archive in {r["archive"] for r in rows}:
        data = open(archive.removeprefix("file:"), "rb").read()
        records = sorted((r for r in rows if r["archive"] == archive), key=lambda r: r["offset"])
        assert [r["offset"] for r in records] == [0, *(r["offset"] + r["length"] for r in records[:-1])] and records[-1]["offset"] + records[-1]["length"] == len(data)
        for r in records:
            whole = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert int(fields["Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
            body = rest[:-4].partition(b"\r\n\r\n")[2]
            assert body == (want[r["page_id"]] if r["record_type"] == "response" else b"")
            seen[r["record_type"]] += 1
    assert seen["response"] == len(set(want.values())) and sum(seen.values()) == len(want)
    chosen = warc.read_records(index, F.col("page_id") % 7 == 0).collect()
    assert {r["page_id"] for r in chosen} == {i for i in want if i % 7 == 0}
    assert all(r["payload"].encode() == want[r["page_id"]] for r in chosen if r["record_type"] == "response")


def test_byte_ranges_join_neighbours(spark):
    rows = [("a", 0, 10, None, None, "r0", None, 0), ("a", 10, 10, None, None, "r1", None, 1), ("a", 25, 5, None, None, "r2", None, 2), ("a", 90, 20, None, None, "r3", None, 3), ("a", 110, 5, None, None, "r4", None, 4), ("b", 10, 10, None, None, "r5", None, 5)]
    index = spark.createDataFrame(rows, warc.INDEX)
    got = sorted((r["archive"], r["start"], r["stop"], [x["record_id"] for x in r["records"]]) for r in warc.byte_ranges(index, 5, 100).collect())
    assert got == [("a", 0, 30, ["r0", "r1", "r2"]), ("a", 90, 110, ["r3"]), ("a", 110, 115, ["r4"]), ("b", 10, 20, ["r5"])]


def test_a_damaged_record_is_refused():
    member = bytearray(warc.pack_record(warc.record_name(1), "2024-01-01T00:00:00Z", "u", 1, warc.digest32(b"abc"), b"abc", None, 3))
    assert warc.unpack_record(bytes(member))[1] == b"abc"
    whole = gzip.decompress(bytes(member)).replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        warc.unpack_record(gzip.compress(whole))


def phrases(spark):
    rng = random.Random(9)
    words = ["the", "The", "big", "cat", "été", "sat\x0bon", "x" * 70, "a", "of"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\t", "\n"]) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += [None, "", " \t ", "....", "new york city " * 30, "alone in here " * 2_000]
    langs = ["en", "de", None, "und", "l\nf"]
    return spark.createDataFrame([(i, t, langs[i % 5], None, 0) for i, t in enumerate(texts)], DOCS).repartition(4)


def test_collocations_are_their_sql(spark):
    d = phrases(spark).withColumn("phrase", F.lit("clash")).withColumn("share_", F.lit(1))
    frame = d.select("text", "lang").toPandas().astype(object)
    frame = frame.where(frame.notna(), None)
    assert spark_rows(collocations.collocations(d)) == duck_rows(collocations.SQL, tables={"documents": frame})
    assert collocations.collocations(d.limit(0)).count() == 0


def test_a_full_sketch_loses_nothing(spark):
    d = phrases(spark)
    few = collocations.phrase_counts(d, cells=2 * collocations.STRIPE)
    assert (collocations.sketch(d.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")), 1 << 14, 10, 3) == 10).any()
    want = Counter()
    for r in d.collect():
        for piece in __import__("re").split(r"[.,;:!?\n-\r]", (r["text"] or "").translate({i: i + 32 for i in range(65, 91)})):
            w = [x for x in __import__("re").split(r"[ \t]+", piece) if x]
            want.update((r["lang"] or "und", " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    got = {(r["lang"], r["phrase"]): r["c"] for r in few.filter("phrase is not null").collect()}
    assert got == {k: c for k, c in want.items() if c >= 10}


def test_scores_pass_64_bits(spark):
    big = 10**12
    counts = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big + 1), ("en", "a b", big)], "lang string, phrase string, c long")
    got = collocations.scored(counts.filter("phrase = 'a b'"), counts).first()
    assert got["score"] == 10**6 * big * big // (3 * big * (2 * big + 1))


def plain_manifest(rows, fanout=2):
    """Rows (doc_id, text, lang, source, n_chars), in the order given within a lang."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    enc = lambda v: b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()
    leaf = lambda r, n: sha(enc(r[0]) + enc(r[3]) + enc(r[2]) + enc(n) + enc(r[1]))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout]).encode()) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(levels, i):
        for level in levels[:-1]:
            run = i // fanout * fanout
            yield i - run, level[run:i] + level[i + 1 : run + fanout]
            i //= fanout

    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r, r[4]) for r in rows if r[2] == g]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, r in enumerate(x for x in rows if x[2] == g):
            steps = [*path(trees[g], i), *path(top, k)]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, r[4] + bad if r[4] is not None else None)
            for at, others in steps:
                h = sha("".join([*others[:at], h, *others[at:]]).encode())
            out.append((r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], sha("".join(x for _, o in steps for x in o).encode()), h, h == top[-1][0]))
    return out


@pytest.mark.parametrize("fanout,depth", [(2, 10), (2, 2), (3, 1)])
def test_manifest_is_a_plain_one(spark, fanout, depth):
    rng = random.Random(fanout)
    langs = ["en"] * 40 + ["de", None, "", "ü", "zz"]
    rows = [(i, rng.choice(["a", None, "", "é" * 5, "long " * 9000]), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, 5, 0, 2**63 - 1])) for i in range(400)]
    rows = [(None, "n", "en", None, 3), (None, "n", "en", None, 3), *rows, rows[-1], (10_000, "one", "alone", "s", 1)]
    d = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("leaf", F.lit("clash")).withColumn("grp", F.lit(1))
    got = merkle.manifest(d, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"n_chars": merkle.one_more()}, fanout=fanout, depth=depth)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows, fanout), key=str)


def test_manifest_of_little(spark):
    d = spark.createDataFrame([(14, "t", "en", "s", 1)], DOCS)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    r = merkle.manifest(d, columns).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == hashlib.sha256(b"").hexdigest() and r["verified"]
    assert merkle.manifest(d.limit(0), columns).count() == 0


def test_a_missing_child_fails():
    with pytest.raises(ValueError):
        merkle._whole(4)((("en", 0), [(0, 3, b"x" * 64, [1, 2], [None] * 2, [None] * 2)]))


def test_files_lie_in_the_shared_folder(spark):
    index = warc.write_archives(spark.createDataFrame([(1, "u", "x")], PAGES))
    assert index.first()["archive"].removeprefix("file:").startswith(common.shared_dir(spark).removeprefix("file:"))


def test_packs_take_the_tables_and_stripes_merge_in_a_stream():
    import numpy as np
    import pyarrow as pa

    found = [pa.table({"lang": ["en", "de"], "phrase": pa.array(["a b", "c"], pa.large_string()), "h": pa.array([1, 2], pa.uint64()), "c": pa.array([3, 4], pa.int64())})]
    assert collocations._packs(found, 4).num_rows == 2 and found == []
    cells = np.zeros(16, np.uint8)
    cells[3] = 7
    packed = collocations.halved(cells, 10)
    rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 2], pa.int32()), pa.array([packed] * 3, pa.binary())], names=["stripe", "data"])
    got = [(b.column(0)[0].as_py(), collocations.restored(b.column(1)[0].as_py(), 10).tolist()) for b in collocations._merged(10)([rows])]
    assert got == [(0, [0, 0, 0, 10] + [0] * 12), (2, cells.tolist())]
