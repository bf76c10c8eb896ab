"""Golden cases of the column expressions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stackleaf.functions import headings as hd
from stackleaf.functions import keys, replies
from stackleaf.functions import text as tx
from stackleaf.plans.settings import Settings, fingerprint
from stackleaf.sources import files as fl


def one(spark, value, kind, *exprs):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(*exprs).first()
    return row[0] if len(exprs) == 1 else tuple(row)


def test_settings_fingerprint(spark):
    assert Settings().fingerprint() == "937b34c5ee47"
    assert Settings(chunk_max_tokens=64).fingerprint() != "937b34c5ee47"
    assert one(spark, "", "string", fingerprint()) == "937b34c5ee47"
    table = one(spark, 64, "int", fingerprint(chunk_max_tokens=F.col("x")))
    assert table == Settings(chunk_max_tokens=64).fingerprint()


@pytest.mark.parametrize(
    "digest, expected",
    [
        ("f" * 64, 9223372036854775807),
        ("0" * 64, 0),
        (hashlib.sha256(b"abc").hexdigest(), 3751779285736625581),
    ],
)
def test_binary_hash(spark, digest, expected):
    assert int(digest, 16) % 2**63 == expected
    assert one(spark, digest, "string", keys.binary_hash(F.col("x"))) == expected


@pytest.mark.parametrize(
    "path, name, end, stem",
    [
        ("/a b/My Book-v1.tar.PDF", "My Book-v1.tar.PDF", ".pdf", "my_book_v1.tar"),
        ("/a/README", "README", "", "readme"),
        ("/a/.hidden", ".hidden", "", ".hidden"),
        ("plain.md", "plain.md", ".md", "plain"),
    ],
)
def test_file_names(spark, path, name, end, stem):
    x = F.col("x")
    assert one(spark, path, "string", keys.filename(x), keys.suffix(x), keys.stem(x)) == (name, end, stem)


def test_page_codec(spark):
    x = F.col("x")
    assert one(spark, "", "string", keys.decode_pages(x)) == []
    assert one(spark, "1,2,10", "string", keys.decode_pages(x)) == [1, 2, 10]
    assert one(spark, [1, 2, 10], "array<int>", keys.encode_pages(x)) == "1,2,10"
    assert one(spark, [], "array<int>", keys.encode_pages(x)) == ""


@pytest.mark.parametrize("ch", list(tx.BLANKS))
def test_every_blank_is_stripped_and_splits(spark, ch):
    x = F.col("x")
    got = one(spark, f"{ch}a.{ch}b{ch}", "string", tx.strip(x), tx.sentences(x), tx.words(x))
    assert got == (f"a.{ch}b", ["a.", "b"], 2)


def test_word_lists_by_whole_classes(spark):
    solid = [chr(i) for i in range(0x3100) if chr(i) not in tx.BLANKS] + ["\ue000", "\U0001f600"]
    text = "".join(f"{c}{b}" for c, b in zip(solid, tx.BLANKS * len(solid), strict=False))
    x = F.col("x")
    assert one(spark, text, "string", tx.word_list(x), tx.words(x)) == (solid, len(solid))
    assert one(spark, f" \n{text}\t", "string", tx.word_list(x)) == solid
    assert one(spark, " \n", "string", tx.word_list(x)) == one(spark, "", "string", tx.word_list(x)) == []


def test_clean_and_paragraphs(spark):
    x = F.col("x")
    assert one(spark, "\n a\n\n\n\nb\n\nc \n", "string", tx.clean(x)) == "a\n\nb\n\nc"
    assert one(spark, "a\n\n \n\nb\nc\n\n\n\nd", "string", tx.paragraphs(x)) == ["a", "b\nc", "d"]
    # Windows line ends hold no blank line in this form: one paragraph
    assert one(spark, "a\r\n\r\nb", "string", tx.paragraphs(x)) == ["a\r\n\r\nb"]


@pytest.mark.parametrize(
    "heading, number, level, ancestors",
    [
        ("1 Intro", "1", 1, []),
        ("1.2.3 Deep", "1.2.3", 3, ["1", "1.2"]),
        ("  2.1\tTab", "2.1", 2, ["2"]),
        ("1.", "", 1, []),
        ("3. Dot", "", 1, []),
        ("A.1 Appendix", "", 1, []),
        ("2019 Results", "2019", 1, []),
        ("1.2", "1.2", 2, ["1"]),
        ("1.2x", "", 1, []),
        ("", "", 1, []),
    ],
)
def test_section_numbers(spark, heading, number, level, ancestors):
    n = hd.section_number(F.col("x"))
    got = one(spark, heading, "string", n, hd.heading_level(n), hd.ancestor_numbers(n))
    assert got == (number, level, ancestors)


@pytest.mark.parametrize(
    "reply, expected",
    [
        ("# Summary\n\nX", "X"),
        ("### SUMMARY  \nX", "X"),
        ("**Summary:** X", "X"),
        ("Summary: X", "X"),
        (" ** summary ** : ** X", "X"),
        ("# Summary\n\n**Summary:** X", "X"),
        ("Summary of X", "Summary of X"),
        ("X. Summary: Y", "X. Summary: Y"),
        ("", ""),
    ],
)
def test_clean_summary(spark, reply, expected):
    assert one(spark, reply, "string", replies.clean_summary(F.col("x"))) == expected


def test_fallback_and_structured_reply(spark):
    text = "é" * 400
    got = one(
        spark, text, "string", replies.summary_or_fallback(F.lit(None).cast("string"), F.col("x"))
    )
    assert got == text[:300]
    field = replies.structured_field(F.col("x"))
    assert one(spark, '{"summary": "s"}', "string", field) == "s"
    assert one(spark, '{"other": "s"}', "string", field) == ""
    assert one(spark, "no json", "string", field) == ""


@pytest.mark.parametrize(
    "source, kind, family",
    [
        ("https://www.youtube.com/watch?v=1", "youtube", None),
        ("https://youtu.be/1", "youtube", None),
        ("http://example.com/a.pdf", "web", None),
        ("/a/B.PDF", "pdf", "document"),
        ("/a/n.ipynb", "notebook", None),
        ("/a/x.Md", "markdown", "plaintext"),
        ("/a/x.txt", "text", "plaintext"),
        ("/a/x.docx", "unknown", None),
    ],
)
def test_content_type_and_route(spark, source, kind, family):
    x = F.col("x")
    assert one(spark, source, "string", fl.content_type(x), fl.route(x)) == (kind, family)
