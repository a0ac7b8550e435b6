"""Small tables with what operators have to put up with, and plain versions of their results."""

from __future__ import annotations

import re
import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside; as further columns they must neither clash nor get lost.
CLASHING = ["row", "n", "key", "whole", "body", "bucket", "h", "size", "rate", "group", "fp", "digest", "same", "found", "id"]
LONG = "very long text with words " * 4000


def documents(spark, texts, sources=None, langs=None, ids=None):
    rows = [
        (
            i if ids is None else ids[i],
            t,
            "en" if langs is None else langs[i],
            f"s{i % 3}" if sources is None else sources[i],
            len(t or ""),
        )
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def odd_documents(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    texts = [
        None, "", " \t\n", "one", "o n e", " one", "two words", "two  words", "two words", LONG, LONG + " ",
        "été à la plage", "ÉTÉ À LA PLAGE", "three little words here", "three little words here", "x\x00y", "a b",
    ]
    ids = [*range(len(texts) - 2), None, 3]
    sources = [None if i % 5 == 0 else f"s{i % 3}" for i in range(len(texts))]
    langs = [None if i % 4 == 0 else "en" for i in range(len(texts))]
    docs = documents(spark, texts, sources, langs, ids)
    return docs.unionByName(docs.where("doc_id in (6, 9)"))


def with_clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING))


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def fold(doc_id, count):
    return zlib.crc32(str(doc_id).encode()) % count


class Sets:
    """Union-find."""

    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, n):
        while self.parent[n] != n:
            self.parent[n] = self.parent[self.parent[n]]
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
