import io
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findery.operators import chunking
from findery.plans import ingest
from findery.sources import files

SAMPLE = """# Guide

First line
second line.

## Setup

```bash
pip install x
# no heading
```

| Name | Value |
| --- | :---: |
| a | b |

#### Deep
~~~
open fence
"""


def test_markdown_blocks():
    got = chunking.markdown_blocks(SAMPLE)
    assert [(b["block_type"], b["block_text"], b["heading_path"], b["start_line"], b["end_line"]) for b in got] == [
        ("heading", "Guide", ["Guide"], 1, 1),
        ("paragraph", "First line second line.", ["Guide"], 3, 4),
        ("heading", "Setup", ["Guide", "Setup"], 6, 6),
        ("code_block", "pip install x\n# no heading", ["Guide", "Setup"], 8, 11),
        ("table", "| Name | Value |\n| --- | :---: |\n| a | b |", ["Guide", "Setup"], 13, 15),
        ("heading", "Deep", ["Guide", "Setup", "Deep"], 17, 17),
        ("code_block", "open fence", ["Guide", "Setup", "Deep"], 18, 19),
    ]
    assert got[3]["language"] == "bash" and [b["parent_seq"] for b in got] == [None, 0, 0, 2, 2, 2, 5]


def test_plain_blocks():
    got = chunking.plain_blocks("a\n b \n\n\nc")
    assert [(b["block_text"], b["start_line"], b["end_line"]) for b in got] == [("a b", 1, 2), ("c", 5, 5)]


units = st.lists(st.tuples(st.booleans(), st.integers(1, 30)), max_size=40)


@given(units, st.integers(5, 40), st.integers(0, 4))
def test_chunks_cover_all_units_in_order(us, target, overlap):
    us = [(*u, k) for k, u in enumerate(us)]
    groups = chunking.group_units(us, chunking.Policy("p", target, overlap))
    seen = [u for g in groups for u in g]
    assert {u[2] for u in seen} == set(range(len(us)))
    for g in groups:
        assert [u[2] for u in g] == list(range(g[0][2], g[-1][2] + 1))
        assert len(g) == 1 or sum(u[1] for u in g) <= target
        assert not any(u[0] for u in g[1:])


def test_policies_are_validated():
    with pytest.raises(ValueError):
        chunking.Policy("p", 10, 10)


def test_chunks_are_linked_and_hashed(spark):
    docs = spark.createDataFrame([(1, SAMPLE), (2, None), (3, "")], "document_id long, text string")
    got = chunking.chunk(chunking.parse(docs), chunking.POLICIES["heading_512_64"]).orderBy("chunk_seq").collect()
    assert [(r.document_id, r.chunk_seq, r.heading_path, r.prev_seq, r.next_seq) for r in got] == [
        (1, 0, ["Guide"], None, 1), (1, 1, ["Guide", "Setup"], 0, 2), (1, 2, ["Guide", "Setup", "Deep"], 1, None),
    ]
    assert got[0].chunk_text == "# Guide\n\nFirst line second line." and got[0].token_count == 6
    assert got[2].chunk_text.endswith("```\nopen fence\n```")


def hwpx(*sections):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, body in enumerate(sections):
            z.writestr(f"Contents/section{k}.xml", f'<s xmlns:h="urn:h">{body}</s>')
    return out.getvalue()


def test_extraction_by_extension(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    (tmp_path / "c.hwpx").write_bytes(hwpx("<h:p><h:r><h:t>para</h:t></h:r></h:p><h:p><h:tbl><h:tr><h:tc><h:t>x|y</h:t></h:tc><h:tc><h:t>2</h:t></h:tc></h:tr></h:tbl></h:p>"))
    (tmp_path / "d.hwpx").write_bytes(b"no zip")
    (tmp_path / "e.xyz").write_text("?")
    raw = files.raw_files(spark, str(tmp_path))
    got = files.extract(raw).withColumn("file", F.element_at(F.split("path", "/"), -1)).orderBy("file", "block_seq").collect()
    assert [(r.file, r.extraction_status, r.block_text) for r in got] == [
        ("a.md", "succeeded", "T"), ("a.md", "succeeded", "body"), ("b.txt", "succeeded", "one"), ("b.txt", "succeeded", "two"),
        ("c.hwpx", "succeeded", "para"), ("c.hwpx", "succeeded", "| x\\|y | 2 |\n| --- | --- |"), ("d.hwpx", "failed", None), ("e.xyz", "failed", None),
    ]
    known = raw.where(F.col("path").endswith("a.md"))
    (tmp_path / "a2.md").write_text("# T\n\nbody")
    left = files.new_only(files.raw_files(spark, str(tmp_path)), known)
    assert sorted(r.path.rpartition("/")[2] for r in left.collect()) == ["b.txt", "c.hwpx", "d.hwpx", "e.xyz"]


def test_html_blocks():
    got = files.html_blocks("<html><head><style>x</style></head><body><h1>A &amp; B</h1><p>one <b>two</b></p><ul><li>i</li></ul><h2>C</h2>tail</body>")
    assert [(b["block_type"], b["block_text"], b["heading_path"]) for b in got] == [
        ("heading", "A & B", ["A & B"]), ("paragraph", "one two", ["A & B"]), ("paragraph", "i", ["A & B"]), ("heading", "C", ["A & B", "C"]), ("paragraph", "tail", ["A & B", "C"]),
    ]


def test_ingestion_in_batches(spark, tmp_path):
    out = str(tmp_path / "out")

    def batch(name, contents):
        (tmp_path / name).mkdir()
        for k, (file, text) in contents.items():
            (tmp_path / name / file).write_text(text)
        raw = files.raw_files(spark, str(tmp_path / name))
        ids = F.create_map(*[x for k, (file, _) in contents.items() for x in (F.lit(file), F.lit(k))])
        own = raw.withColumn("document_id", F.element_at(ids, F.element_at(F.split("path", "/"), -1)).cast("long"))
        return {r.document_id: r for r in ingest.ingest(own, out, name, dimension=8).collect()}

    first = batch("b1", {5: ("a.md", SAMPLE), 6: ("b.txt", "old words"), 7: ("c.xyz", "?")})
    assert (first[5].extraction_status, first[5].chunk_count > 0, first[7].extraction_status, first[7].error, first[7].chunk_count) == ("succeeded", True, "failed", "unsupported extension .xyz", 0)
    chunks = ingest.current(spark, out, "chunks")
    assert chunks.groupBy("policy").count().count() == 3 and ingest.current(spark, out, "embeddings").count() == chunks.count()
    assert ingest.refreshed_statistics(spark, out).where("term = 'guide'").count() == 3
    batch("b2", {6: ("b.txt", "fresh words"), 8: ("d.md", "# Other")})
    texts = {r.document_id: r.chunk_text for r in ingest.current(spark, out, "chunks").where("policy = 'heading_512_64'").orderBy("chunk_seq").collect()}
    assert texts[6] == "fresh words" and texts[8] == "# Other" and 5 in texts
    terms = {r.term: r.corpus_chunk_count for r in ingest.refreshed_statistics(spark, out).where("policy = 'heading_512_64'").collect()}
    assert "fresh" in terms and "old" not in terms and "guide" in terms and set(terms.values()) == {5}
    profiles = spark.createDataFrame([("stand_in",), ("other",)], "profile string")
    assert {r.profile for r in ingest.pending_embeddings(spark, out, profiles).collect()} == {"other"}


def test_chunks_of_documents_equal_chunks_of_blocks(spark):
    docs = spark.createDataFrame([(1, SAMPLE), (2, None), (3, ""), (4, SAMPLE * 3)], "document_id long, text string").repartition(2)
    policy = chunking.Policy("p", 8, 3)
    key = lambda df: sorted(map(repr, df.collect()))
    whole = chunking.chunk_documents(docs, [policy, chunking.POLICIES["heading_512_64"]])
    assert key(whole.where("policy = 'p'")) == key(chunking.chunk(chunking.parse(docs), policy)) and whole.select("policy").distinct().count() == 2
    for r in whole.where("document_id = 1").collect():
        assert SAMPLE[r.start_char : r.end_char].splitlines() == SAMPLE.splitlines()[r.start_line - 1 : r.end_line] and len(r.block_seqs) >= 1


def test_anchors_are_kept_where_all_blocks_share_them():
    own = [chunking.block(k, "paragraph", "one two", ["P"], page=p, sheet="s") for k, p in enumerate([1, 1, 2])]
    got = chunking.chunk_rows(1, own, chunking.Policy("p", 4, 0))
    assert [(r["page"], r["sheet"], r["start_line"], r["block_seqs"]) for r in got] == [(1, "s", None, [0, 1]), (2, "s", None, [2])]
    assert chunking.chunk_rows(1, own, chunking.Policy("p", 99, 0))[0]["page"] is None


@given(st.lists(st.integers(1, 9), max_size=12), st.integers(0, 20))
def test_overlap_is_the_longest_end_that_fits(sizes, limit):
    us = [(False, n, k) for k, n in enumerate(sizes)]
    fitting = [us[k:] for k in range(len(us)) if sum(u[1] for u in us[k:]) <= limit]
    assert chunking._tail(us, limit) == (max(fitting, key=len, default=us[-1:]) if limit else [])


def test_docx_export():
    from xml.etree import ElementTree

    from findery.sources.docx import markdown_to_docx

    with zipfile.ZipFile(io.BytesIO(markdown_to_docx(SAMPLE, "Title & more"))) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = [e.text for e in root.iter() if e.tag.endswith("}t")]
    assert texts[:3] == ["Title & more", "Guide", "First line second line."] and "pip install x" in texts and texts[-1] == "open fence"


def test_models_fail_over(spark):
    from findery.plans import models

    def broken(texts):
        raise OSError("down")

    def lengths(texts):
        return [[float(len(t)), 1.0] for t in texts]

    call = models.first_working([("a", broken), ("b", lengths)])
    df = spark.createDataFrame([(1, "abc"), (2, None)], "k long, text string")
    assert {r.k: r.embedding for r in models.embedded(df, call, "text", 2).collect()} == {1: [3.0, 1.0], 2: None}
    with pytest.raises(models.NoRouteAnswered, match="a: OSError: down"):
        models.first_working([("a", broken)])(["x"])
    with pytest.raises(Exception, match="python-mecab-ko"):
        df.select(models.morphs(F.col("text"))).collect()
