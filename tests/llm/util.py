"""Small inputs and brute-force helpers."""

import hashlib
import re

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sf_rows(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Texts that every operator must take: null, empty, blank, very long, odd white space, not ASCII.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "a b c d e f g h i j k l m n o p q " * 400), (905, "x" * 30000), (906, "é ü 漢字 \x1c z\x0bq"), (None, "null id text here " * 8), (None, None)]
