"""URLs: normal forms, trap tests, embedded state, robots rules, consistent hashing."""

from __future__ import annotations

import hashlib
import json
import posixpath
import urllib.parse
import urllib.robotparser
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tracking parameters, trap limits, sensitive path prefixes.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid sessionid sid ref spm".split()
MAX_DEPTH, MAX_PARAMS = 8, 6
SENSITIVE = "login signin signup register auth admin checkout payment password reset".split()
#: Patterns of API paths in scripts.
API_PATTERNS = [r"""fetch\(["'](/api/[^"']+)["']""", r"""axios\.(?:get|post)\(["'](/api/[^"']+)["']""", r"""["'](/api/v\d+/[^"']+)["']""", r"""["'](/v\d+/(?:papers|articles|advisories|cve)[^"']*)["']"""]
DEFAULT_PORTS = {"http": ":80", "https": ":443"}


def normal_url(url: str) -> str:
    parts = urllib.parse.urlsplit(url.strip())
    scheme, host = parts.scheme.lower(), parts.netloc.lower()
    host = host.removesuffix(DEFAULT_PORTS.get(scheme, "\0"))
    path = posixpath.normpath(parts.path) if parts.path else "/"
    if parts.path.endswith("/") and path[-1] != "/":
        path += "/"
    pairs = [p for p in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if p[0].lower() not in TRACKING]
    return urllib.parse.urlunsplit((scheme, host, path, urllib.parse.urlencode(sorted(pairs, key=lambda p: p[0])), ""))


def normalize(url: str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda u: None if u is None else normal_url(u))

    return run(F.col(url))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def is_trap(url: str | Column) -> Column:
    """Deep paths, repeating segments, many parameters or sensitive paths (a prefix test)."""
    url = F.col(url) if isinstance(url, str) else url
    parts = F.filter(F.split(_path(url), "/"), lambda x: x != "")
    repeated = (F.size(parts) >= 4) & F.exists(parts, lambda x: F.size(F.filter(parts, lambda y: y == x)) >= 3)
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x.rlike("^[^=]*=."))
    return (F.size(parts) > MAX_DEPTH) | repeated | (F.size(pairs) > MAX_PARAMS) | F.lower(_path(url)).rlike(f"/(?:{'|'.join(SENSITIVE)})")


def api_paths(html: str | Column, base: str = "") -> Column:
    """Sorted distinct API paths that a page's scripts name, base put before them."""
    html = F.col(html) if isinstance(html, str) else html
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in API_PATTERNS])
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.lit(base.rstrip("/")), x))))


def hydration(html: str | Column) -> Column:
    """Embedded state: next_data, nuxt_data, initial_state as JSON strings, json_ld as a list; what doesn't parse is null or left out."""
    html = F.col(html) if isinstance(html, str) else html
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    script = lambda name: valid(F.nullif(F.regexp_extract(html, rf'(?s)<script id="{name}"[^>]*>(.*?)</script>', 1), F.lit("")))
    state = valid(F.nullif(F.regexp_extract(html, r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\});", 1), F.lit("")))
    linked = F.filter(F.regexp_extract_all(html, F.lit(r'(?s)<script type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1)), lambda x: F.try_parse_json(x).isNotNull())
    return F.struct(script("__NEXT_DATA__").alias("next_data"), script("__NUXT_DATA__").alias("nuxt_data"), state.alias("initial_state"), linked.alias("json_ld"))


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def robot_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, rules) of (host, body): the rules of each host's robots.txt that hold for an agent, in order, as (path, allow). Each file is read once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column(1).to_pylist():
                parser = urllib.robotparser.RobotFileParser()
                parser.parse((body or "").splitlines())
                entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
                out.append([{"path": urllib.parse.unquote(r.path), "allow": r.allowance} for r in (entry.rulelines if entry else [])])
            kind = pa.list_(pa.struct([("path", pa.string()), ("allow", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["host", "rules"])

    return robots.select(F.lower("host").alias("host"), "body").mapInArrow(read, "host string, rules array<struct<path:string,allow:boolean>>")


def with_permission(pages: DataFrame, rules: DataFrame, into: str = "allowed") -> DataFrame:
    """pages (url, ...) with whether their host's rules let them be fetched: the first rule whose path begins the URL's decides; hosts without rules allow all."""
    path = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    path = F.when(F.length(path) == 0, "/").otherwise(path)
    first = F.get(F.filter("rules", lambda r: F.startswith(path, r["path"]) | (r["path"] == "*")), F.lit(0))
    named = rules.select(F.col("host").alias("_host"), "rules")
    return pages.join(named, host("url") == F.col("_host"), "left").withColumn(into, F.coalesce(first["allow"], F.lit(True))).drop("_host", "rules")


class Ring:
    """Consistent hashing: virtual nodes on a ring of unsigned 64-bit points, keys go to the next point clockwise."""

    def __init__(self, nodes: list[str], virtual: int = 128, mark: str = "{node}#vnode_{i}", hash_: str = "sha256"):
        self.hash_ = hash_
        points = sorted((self.point(mark.format(node=n, i=i)), n) for n in nodes for i in range(virtual))
        self.points, self.owners, self.n = np.array([p for p, _ in points], np.uint64), [n for _, n in points], len(nodes)

    def point(self, key: str) -> int:
        return int.from_bytes(hashlib.new(self.hash_, key.encode()).digest()[:8], "big")

    def node(self, key: str) -> str:
        return self.owners[int(np.searchsorted(self.points, np.uint64(self.point(key)), side="right")) % len(self.owners)]

    def preference(self, key: str, n: int) -> list[str]:
        at = int(np.searchsorted(self.points, np.uint64(self.point(key)), side="right"))
        around = (self.owners[(at + i) % len(self.owners)] for i in range(len(self.owners)))
        return list(dict.fromkeys(around))[: min(n, self.n)]

    def assign(self, key: str | Column, n: int = 1) -> Column:
        """The key's first n nodes. Keys are hashed by Spark; the ring, of a fixed number of points, goes along with each point's nodes worked out."""
        points, around = self.points, [list(dict.fromkeys(self.owners[at:] + self.owners[:at]))[: min(n, self.n)] for at in range(len(self.owners))]

        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            known = s.notna().to_numpy()
            at = np.searchsorted(points, np.array([int(x, 16) for x in s[known]], np.uint64), side="right") % len(points)
            out = np.full(len(s), None, object)
            for place, slot in zip(np.flatnonzero(known), at, strict=True):
                out[place] = around[slot]
            return pd.Series(out)

        key = F.col(key) if isinstance(key, str) else key
        digest = F.md5(key) if self.hash_ == "md5" else F.sha2(key, int(self.hash_.removeprefix("sha")))
        return run(F.substring(digest, 1, 16))


def css_select(html: Column, selector: str) -> Column:
    """Texts of the elements that match a selector of tags, .classes, #ids and descent."""
    from .css import select_texts

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else select_texts(h, selector))

    return run(html)


def parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True
