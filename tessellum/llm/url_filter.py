"""URL filter (8): a trie over reversed host labels and path segments, with longest-match precedence."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessellum.llm.common import cut, table

#: Rules of one broadcast trie; longer lists are matched trie after trie, the better rule staying.
MAX_RULES = 500_000

_LOWER = {c: c + 32 for c in range(65, 91)}
_HOST, _PATH = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


class UrlTrie:
    """Rules under the labels of their host from the last to the first, then under the segments of their path.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The rule with the most host
    labels wins, then the longest path; of equal rules with both verdicts, block wins. What follows the last slash of a rule
    may end inside a segment: a node holds these ends by their text and probes a segment's beginnings of their lengths,
    longest first, so a match costs no more with many rules of one host.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no host label holds a slash
            segments = path.split("/")
            for segment in segments[:-1]:
                node = node.setdefault(("", segment), {})
            ends, lengths = node.setdefault("", ({}, []))
            if len(segments[-1]) not in lengths:
                lengths.append(len(segments[-1]))
                lengths.sort(reverse=True)
            known = ends.get(segments[-1])
            ends[segments[-1]] = (f"{host}{path}", "block" if "block" in (verdict, known and known[1]) else verdict)

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path characters, rule, verdict) of the longest rule that fits."""
        node, depth, best = self.root, 0, None
        segments = None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            depth += 1
            at = node.get("/")
            if at is None:
                continue
            segments = path.split("/") if segments is None else segments
            longest, length = None, 0  # a deeper node's rules are longer
            for k, segment in enumerate(segments):
                ends, lengths = at.get("", ({}, ()))
                for n in lengths:
                    found = ends.get(segment[:n]) if n <= len(segment) else None
                    if found:
                        longest = (depth, length + n, *found)
                        break
                if k + 1 == len(segments) or (at := at.get(("", segment))) is None:
                    break
                length += len(segment) + 1
            best = longest or best
        return best


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Rows ``(id, host, path, rule, verdict)``, one for each row of ``pages``.

    Null urls and urls without ``://`` have empty host and path and get ``default``; repeated rows and null ids stay as
    they are; other columns of ``pages`` aren't read. No shuffle: the trie of at most ``max_rules`` rules is broadcast.
    """
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()
    state = pages.select(id_col, url_col)
    chunks = [rules[i : i + max_rules] for i in range(0, len(rules), max_rules)] or [[]]
    for k, chunk in enumerate(chunks):
        trie = spark.sparkContext.broadcast(UrlTrie(chunk))

        def judge(batches, trie=trie, k=k):
            find, hosts = trie.value.match, {}
            for b in batches:
                known = list(zip(*(b.column(i).to_pylist() for i in range(4, 6)), strict=True)) if k else [None] * b.num_rows
                rules_before = b.column(2).to_pylist() if k else known
                verdicts = b.column(3).to_pylist() if k else known
                rule, verdict, depth, length, host_out, path_out = [], [], [], [], [], []
                for i, url in enumerate(b.column(1).to_pylist()):
                    host, path = split_url(url)
                    got = find(host, path)
                    if k and known[i][0] >= 0 and (got is None or known[i] > got[:2] or (known[i] == got[:2] and verdicts[i] == "block")):
                        got = (*known[i], rules_before[i], verdicts[i])
                    d, n, r, v = got or (-1, -1, None, default)
                    for out, x in ((rule, r), (verdict, v), (depth, d), (length, n), (host_out, host), (path_out, path)):
                        out.append(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(depth, pa.int32()), pa.array(length, pa.int32()), pa.array(host_out, pa.string()), pa.array(path_out, pa.string())],
                    names=["_id", "_url", "rule", "verdict", "_depth", "_length", "host", "path"],
                )

        state = (cut(state) if k else state).mapInArrow(judge, f"_id {id_type}, _url string, rule string, verdict string, _depth int, _length int, host string, path string")
    return state.selectExpr(f"_id AS `{id_col}`", "host", "path", "rule", "verdict")


#: Fixed values of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP8_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. Null ids and repeated rows stay; null urls and such without ``://`` have
    empty host and path, no rule and the verdict allow; of rules that fit, the longest wins."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
