"""The crawl frontier: how far every URL is from the seeds, and which page led to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.urls import url_domain
from pagequarry.session import work_folder

#: Links of one page that lie in one bucket; a page with more has parts in several.
HEAVY = 100_000


class LinkTable:
    """Distinct links (url, link) in buckets of url, written once and joined without an exchange.

    ``buckets`` is the session's shuffle partitions unless given. Links to the page itself and rows
    without url or link are left out. A page of more than ``heavy`` links is cut into parts by the
    hash of the link, so a hub with a large share of all links is spread over many buckets. The
    bucketed table is external, in a folder below ``spark.checkpoint.dir``; ``close`` forgets it.
    """

    def __init__(
        self, spark: SparkSession, links: DataFrame, same_site: bool = False, heavy: int = HEAVY, buckets: int | None = None
    ) -> None:
        self.spark, self.folder = spark, work_folder(spark)
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        followed = links.select("url", "link").filter("url IS NOT NULL AND link IS NOT NULL AND url != link")
        if same_site:
            followed = followed.filter(url_domain(F.col("url")) == url_domain(F.col("link")))
        self._write(followed.distinct(), "links")
        distinct = self._read("links", "url string, link string")
        # at most one row for each ``heavy`` links
        large = distinct.groupBy("url").count().filter(F.col("count") > heavy)
        self._write(large.select("url", F.ceil(F.col("count") / heavy).cast("int").alias("parts")), "hubs")
        self.hubs = self._read("hubs", "url string, parts int")
        part = F.pmod(F.xxhash64("link"), F.coalesce("parts", F.lit(1)).cast("bigint")).cast("int")
        placed = distinct.join(self.hubs, "url", "left").select("url", part.alias("part"), "link")
        self.name = f"links_{self.folder.rsplit('-', 1)[-1]}"
        (
            placed.repartition(n, "url", "part")
            .write.bucketBy(n, "url", "part").sortBy("url", "part")
            .option("path", f"{self.folder}/bucketed").format("parquet").saveAsTable(self.name)
        )

    def _write(self, table: DataFrame, name: str) -> None:
        table.write.parquet(f"{self.folder}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def from_pages(self, urls: DataFrame) -> DataFrame:
        """Links of the pages in ``urls``, each once: (url, link)."""
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        wanted = urls.join(self.hubs, "url", "left").select("url", parts.alias("part"))
        return self.spark.table(self.name).join(wanted, ["url", "part"]).select("url", "link")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def crawl_frontier(
    links: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    same_site: bool = False,
    heavy: int = HEAVY,
) -> DataFrame:
    """(url, depth, referrer) of every URL reached from the seeds, breadth first.

    ``links`` has ``url`` and ``link``, ``seeds`` has ``url``, all in normal form. Seeds have depth 0
    and no referrer; another URL has one more than the nearest page that links to it, and of those
    the least URL is its referrer. Up to ``max_depth``, where given; with ``same_site`` only links to
    the page's own host are followed. Rows without a URL count for nothing; seeds that nothing
    links to or from are given as well; without seeds there is no row.

    Each round reads the links of the URLs found in the round before, and no others, and writes the
    URLs that no round had. So a lost executor costs a part of a round, cycles end, and the driver
    only learns whether a round found anything. The jobs run when this is called.
    """
    spark = links.sparkSession
    table = LinkTable(spark, links, same_site, heavy)
    schema = "url string, depth bigint, referrer string"
    rounds = f"{table.folder}/rounds"

    def of_round(k: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{rounds}/round={k}")

    try:
        first = seeds.select("url").filter("url IS NOT NULL").distinct()
        found = first.select("url", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("referrer"))
        depth = 0
        found.write.parquet(f"{rounds}/round=0")
        while not of_round(depth).isEmpty() and (max_depth is None or depth < max_depth):
            seen = spark.read.schema(schema).parquet(*(f"{rounds}/round={k}" for k in range(depth + 1)))
            reached = table.from_pages(of_round(depth).select("url"))
            # combined on the map side, so a URL that very many pages link to costs no more
            nearest = reached.groupBy(F.col("link").alias("url")).agg(F.min("url").alias("referrer"))
            new = nearest.join(seen.select("url"), "url", "left_anti")
            depth += 1
            new.select("url", F.lit(depth).cast("bigint").alias("depth"), "referrer").write.parquet(f"{rounds}/round={depth}")
    finally:
        table.close()
    return spark.read.schema(schema).parquet(*(f"{rounds}/round={k}" for k in range(depth + 1)))
