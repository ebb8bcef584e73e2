"""URL filters: a trie over reversed host labels and path segments.

The rules are a configured list of checked size, so the trie is broadcast; the
urls are never shuffled. Longest match wins: the deepest host first, then the
longest path; of two equal rules, the later one in the list holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules above this number are refused rather than broadcast.
MAX_RULES = 1_000_000

#: (verdict, host, path) of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


class Trie:
    """Labels from the top-level domain down, then path segments; the text after a rule's last slash is kept at its node."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.hosts: dict = {}
        for verdict, host, path in rules:
            node = self.hosts
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            *segments, rest = path.split("/")
            node = node.setdefault(None, {})  # labels are strings: None leads on to the paths
            for s in segments:
                node = node.setdefault(s, {})
            node.setdefault(None, {})[rest] = (f"{host}{path}", verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, on_the_way = self.hosts, []
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                on_the_way.append(node[None])
        for paths in reversed(on_the_way):
            if hit := self._path(paths, path.split("/")):
                return hit
        return None

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, s in enumerate(segments):
            for rest in sorted(node.get(None, {}), key=len):
                if s.startswith(rest):
                    best = node[None][rest]
            node = node.get(s)
            if node is None:
                break
        return best


def url_parts(url):
    """Host and path columns: null or no :// gives both empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper = "".join(map(chr, range(65, 91)))
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    A null url, or one without ://, has an empty host and path, fits no rule and
    gets the default verdict, with a null rule. Repeated rows give repeated
    results; an empty table gives no rows; only page_id and url are read. An
    empty host or label fits nothing. Every row is judged by itself, so copies
    and hot hosts need no care.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            hits = [trie.value.find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(hits, columns=["rule", "verdict"])

    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("hit", judge("host", "path")).select("page_id", "host", "path", "hit.rule", "hit.verdict")
