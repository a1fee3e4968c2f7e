"""Crawls over fetched pages: a builder, a decorator, and frontiers that are saved and taken up again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import urls as U
from .sources.snapshots import SnapshotTable

Parser = Callable[[DataFrame], DataFrame]
PENDING = "url string, priority int, seq bigint, dont_filter boolean, meta map<string,string>"


@dataclass(frozen=True)
class Crawl:
    """A crawl's plan. ``run`` takes fetched pages (url, html) and gives the parser's rows of those that the plan lets in."""

    name: str = "crawl"
    start_urls: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    delay: float = 0.5
    cache: bool = False
    most: int | None = None
    parser: Parser | None = field(default=None, compare=False)

    def admit(self, pages: DataFrame) -> DataFrame:
        """Pages of allowed domains that are no traps, one of each URL, in the order first seen, with how long each waits for its host."""
        kept = pages.filter(~U.is_trap("url"))
        if self.allowed_domains:
            host = U.host("url")
            inside = F.lit(False)
            for d in self.allowed_domains:
                inside = inside | (host == d.lower()) | host.endswith("." + d.lower())
            kept = kept.filter(inside)
        if self.cache:
            kept = kept.dropDuplicates(["url"])
        if self.most is not None:
            kept = kept.orderBy("url").limit(self.most)
        turn = F.row_number().over(Window.partitionBy(U.host("url")).orderBy("url")) - 1
        return kept.withColumn("wait", turn * F.lit(self.delay))

    def run(self, pages: DataFrame) -> DataFrame:
        admitted = self.admit(pages)
        return self.parser(admitted) if self.parser else admitted


class CrawlBuilder:
    """Puts a plan together step by step; every step gives a new builder."""

    def __init__(self, name: str = "crawl", plan: Crawl | None = None):
        self._plan = plan or Crawl(name)

    def _with(self, **changes) -> CrawlBuilder:
        return CrawlBuilder(plan=replace(self._plan, **changes))

    def start_url(self, *urls: str) -> CrawlBuilder:
        return self._with(start_urls=self._plan.start_urls + urls)

    def allowed_domains(self, *domains: str) -> CrawlBuilder:
        return self._with(allowed_domains=self._plan.allowed_domains + domains)

    def with_rate_limit(self, seconds: float) -> CrawlBuilder:
        return self._with(delay=seconds)

    def with_cache(self, on: bool = True) -> CrawlBuilder:
        return self._with(cache=on)

    def limit(self, most: int) -> CrawlBuilder:
        return self._with(most=most)

    def parse_with(self, parser: Parser) -> CrawlBuilder:
        return self._with(parser=parser)

    def build(self) -> Crawl:
        return self._plan


def crawl(*start_urls: str, allowed_domains: list[str] | None = None, min_delay: float = 0.5, max_requests: int | None = None) -> Callable[[Parser], CrawlBuilder]:
    """Decorator: the function parses admitted pages; what it becomes is a builder of its name."""

    def wrap(parser: Parser) -> CrawlBuilder:
        return CrawlBuilder(plan=Crawl(parser.__name__, start_urls, tuple(allowed_domains or ()), min_delay, most=max_requests, parser=parser))

    return wrap


class CrawlState:
    """A frontier's pending requests and the URLs met, as snapshots: a failed save leaves the one before in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.pending, self.met = SnapshotTable(spark, f"{root.rstrip('/')}/pending"), SnapshotTable(spark, f"{root.rstrip('/')}/met")

    def save(self, pending: DataFrame, met: DataFrame) -> None:
        """pending as PENDING; met (url)."""
        self.met.write(met.select("url").distinct())
        self.pending.write(pending.select(*[f.split()[0] for f in PENDING.split(", ")]))

    def restore(self, met: DataFrame | None = None) -> DataFrame:
        """Pending requests, highest priority and earliest first; URLs already met since go, unless they ask not to be filtered. No state gives none."""
        held = self.pending.current()
        if held is None:
            return self.spark.createDataFrame([], PENDING)
        rows = held.groupBy("url").agg(*[F.min_by(c, F.struct(-F.col("priority"), "seq")).alias(c) for c in ("priority", "seq", "dont_filter", "meta")])
        if met is not None:
            gone = met.select(F.col("url").alias("_met")).distinct()
            rows = rows.join(gone, (F.col("url") == F.col("_met")) & ~F.coalesce("dont_filter", F.lit(False)), "left_anti")
        return rows.orderBy(F.desc("priority"), "seq")
