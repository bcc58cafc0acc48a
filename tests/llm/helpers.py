"""Rows that the operators must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **columns):
    """A documents table, stored, since the operators read their input more than once."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS) if not columns else spark.createDataFrame(rows, DOCS).withColumns(columns)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sample_texts(sf_dir=SF_DIR):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))


def alike_modulo_powers_of_two():
    """Two words of 1,024 letters that polynomial hashes modulo powers of two take for one."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
