"""Small inputs with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"


def odd_texts() -> list[str]:
    return [
        "", " ", "  ", "\n", "a", "one two", "one two three", "One Two Three", " a  b   c ", "a\n\nb", "\t\x0b\x0c x \r\n", "▁▁a ▁",
        "日本語 😀 テスト", "\x00 x", " " * 100 + "x" + " " * 37, "İstanbul ΣΑΣ ΟΔΟΣ", "x<|endoftext|>y <|startoftext|> z", "a  <|endoftext|>  b",
        "ﬁ ½ é ́a \xa0b　c", "\x1cq \x85 r\x1f", "it's we'll 'S 12345 don't", "<s> </s> <unk> <0x0A>", "a\x01b \x01 c", "z" * 3000,
        "word " * 4000, "line one\nline two\nline one\nline one", "&amp; <b>bold</b> | $5 #1 *x*",
    ]


def odd_documents(spark: SparkSession) -> DataFrame:
    """Odd texts with ids, nulls, repeated rows and extra columns named like the operators' own."""
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(odd_texts())]
    rows += [(100, None, "fr"), (None, "no id at all", None), (None, None, None), (5, "one two", "en"), (5, "one two", "en")]
    columns = "id fp key node label host quality tokens toxicity language group template simhash simhash_group kept_id".split()
    columns += "_template _host _n _id _simhash _simhash_group _quality _toxicity".split()
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([(*r, *("x" for _ in columns)) for r in rows], schema)
