"""URL filters: the longest allow or block entry that fits a URL.

An entry is a host suffix and a path prefix. Entries make a trie over reversed
host labels and then path segments (the last segment may be cut anywhere in the
URL's segment). The trie is broadcast if its entries take up to MAX_TRIE_BYTES;
a larger list is joined instead: a URL gives its host suffixes with its path's
prefixes of the lengths that entries have, and these keys meet the entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, own, text_batches

MAX_TRIE_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ``://``; both empty without it."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, rest, 1), UPPER, LOWER), F.regexp_extract(text, rest, 2)


def split_rule(rule: str) -> tuple[str, str]:
    """``host/path`` -> (host, path with its slash); without a slash the path is empty."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


class Trie:
    """Longest match: more host labels first, then the longer path, then block before allow."""

    def __init__(self, rules):
        self.top: dict = {}
        for rule, verdict in rules:
            host, path = split_rule(rule)
            node = self.top
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # the host ends here; path segments follow
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(last, ("", ""))[1] != "block":
                ends[last] = (rule, verdict)

    def find(self, host: str, path: str):
        hosts, node = [self.top], self.top
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in reversed(hosts):
            found, node = None, node.get(None)
            for segment in segments:
                if node is None:
                    break
                for last, entry in node.get(None, {}).items() if len(node.get(None, {})) <= 8 else self._prefixes(node[None], segment):
                    if segment.startswith(last) and (found is None or len(split_rule(entry[0])[1]) > len(split_rule(found[0])[1])):
                        found = entry
                node = node.get(segment)
            if found:
                return found
        return None, None

    @staticmethod
    def _prefixes(ends: dict, segment: str):
        for i in range(len(segment) + 1):
            if (entry := ends.get(segment[:i])) is not None:
                yield segment[:i], entry


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow", url_col: str = "url", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (``host/path``, ``allow`` or ``block``) pairs, or a DataFrame (rule,
    verdict). A rule fits its host and all subdomains if the URL's path starts
    with the rule's. The host with more labels wins, then the longer path, then
    block. Without a fitting rule `rule` is null and the verdict is `default`.

    Null urls and urls without ``://`` have empty host and path, which only a
    rule without a host or path could fit. Each row is judged alone, by its whole
    url, however long; repeated rows agree and an empty table gives none. Other
    columns pass through, whatever their names; columns with the names above are
    replaced.
    """
    host, path = url_parts(F.col(f"`{url_col}`"))
    out = own(pages, "host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    if isinstance(rules, DataFrame):
        table = rules.select("rule", "verdict").where("rule is not null").distinct()
        if (table.agg(F.sum(F.octet_length("rule") + 64)).first()[0] or 0) > max_trie_bytes:
            return _joined(out, table, default)
        rules = [(r.rule, r.verdict) for r in table.toLocalIterator()]
    elif sum(len(r.encode()) + 64 for r, _ in rules) > max_trie_bytes:
        return _joined(out, pages.sparkSession.createDataFrame(rules, "rule string, verdict string"), default)
    held = pages.sparkSession.sparkContext.broadcast(rules)
    text_batches(pages.sparkSession)

    @F.pandas_udf("rule string, verdict string")
    def find(hosts, paths):
        import pandas as pd

        trie = _trie(held)
        return pd.DataFrame([trie.find(h, p) for h, p in zip(hosts, paths)], columns=["rule", "verdict"], dtype=object)

    (got,) = fresh(out, "found")
    found = out.withColumn(got, find("host", "path"))
    return found.withColumn("rule", F.col(f"{got}.rule")).withColumn("verdict", F.coalesce(f"{got}.verdict", F.lit(default))).drop(got)


_built: dict = {"rules": None, "trie": None}


def _trie(held) -> Trie:
    """One trie a broadcast and worker."""
    if _built["rules"] is not held.value:
        _built.update(rules=held.value, trie=Trie(held.value))
    return _built["trie"]


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same result by equal keys: distinct (host, path) pairs meet the rules."""
    slash = F.instr("rule", "/")
    r_host = F.translate(F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), UPPER, LOWER)
    r_path = F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    best = F.min_by(F.struct("rule", "verdict"), F.when(F.col("verdict") == "block", 0).otherwise(1))
    table = rules.select("rule", "verdict", r_host.alias("r_host"), r_path.alias("r_path")).groupBy("r_host", "r_path").agg(best.alias("r"))
    # The lengths that rule paths have: no more numbers than the longest path has characters.
    lengths = F.array(*[F.lit(r[0]) for r in table.select(F.length("r_path")).distinct().collect()])
    asked = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), ".")))
    keys = asked.select("host", "path", F.posexplode(suffixes).alias("depth", "s_host"))
    keys = keys.select("host", "path", "depth", "s_host", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"))
    keys = keys.withColumn("s_path", F.expr("substring(path, 1, n)"))
    hit = keys.join(table, (F.col("s_host") == F.col("r_host")) & (F.col("s_path") == F.col("r_path")))
    won = hit.groupBy("host", "path").agg(F.max_by("r", F.struct("depth", "n")).alias("r"))
    w_host, w_path, w_rule = fresh(parts, "host", "path", "rule")
    out = parts.join(won.toDF(w_host, w_path, w_rule), (F.col("host") == F.col(w_host)) & (F.col("path") == F.col(w_path)), "left")
    return out.withColumn("rule", F.col(f"{w_rule}.rule")).withColumn("verdict", F.coalesce(f"{w_rule}.verdict", F.lit(default))).drop(w_host, w_path, w_rule)
