"""Sources: chunk files, guarded SQL, database rows, HTML, sitemaps and feeds."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import release, ship
from ..operators.chunkers import windows

#: Rows that are held as Python values at once.
ROWS = 100
KEYWORDS = ("ALTER", "CREATE", "DELETE", "DROP", "EXEC", "EXECUTE", "GRANT", "INSERT", "REVOKE", "TRUNCATE", "UPDATE")
CHUNK = "id string, text string, source string, metadata map<string,string>, quality_score double, created_at timestamp"


def load_chunks(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Chunks of a JSON file (a list or an object), JSON lines, CSV or Parquet."""
    if kind not in ("json", "jsonl", "csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    return spark.read.parquet(path) if kind == "parquet" else spark.read.schema(CHUNK).json(path, multiLine=kind == "json")


def writes(sql: Column) -> Column:
    """Whether a statement holds a keyword that changes data, in strings and names too."""
    return F.upper(sql).rlike(f"(^|[^A-Z0-9_])({'|'.join(KEYWORDS)})([^A-Z0-9_]|$)")


def read_only(sql: Column) -> Column:
    return F.upper(F.trim(sql)).startswith("SELECT") & ~writes(sql)


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, max_rows: int | None = None, guard: bool = True) -> DataFrame:
    """A statement over registered views, refused if the guard finds a writing keyword."""
    if guard and spark.range(1).select(writes(F.lit(sql))).first()[0]:
        raise ValueError("only reading statements are allowed")
    df = spark.sql(sql, args=args)
    return df if max_rows is None else df.limit(max_rows)


_DRIVERS = {"postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "sqlite": "sqlite"}


def jdbc_url(dsn: str) -> tuple[str, dict[str, str]]:
    """A database address as Spark's JDBC source takes it, user and password apart; what is no known address stays as it is."""
    u = urlsplit(dsn)
    if u.scheme not in _DRIVERS:
        return dsn, {}
    if u.scheme == "sqlite":
        return f"jdbc:sqlite:{u.path[1:]}", {}
    host = f"{u.hostname or 'localhost'}:{u.port}" if u.port else u.hostname or "localhost"
    login = {k: unquote(v) for k, v in (("user", u.username), ("password", u.password)) if v is not None}
    return f"jdbc:{_DRIVERS[u.scheme]}://{host}{u.path}" + (f"?{u.query}" if u.query else ""), login


def read_database(spark: SparkSession, dsn: str, sql: str, max_rows: int | None = None, **options: str) -> DataFrame:
    """A reading statement on a database; options such as partitionColumn, numPartitions and bounds split it over tasks."""
    if spark.range(1).select(writes(F.lit(sql))).first()[0]:
        raise ValueError("only reading statements are allowed")
    url, login = jdbc_url(dsn)
    df = spark.read.format("jdbc").options(url=url, dbtable=f"({sql}) AS q", **login, **options).load()
    return df if max_rows is None else df.limit(max_rows)


def pages_read(pages: DataFrame, url: str, page: str, success: Column, items: Column, page_size: int = 100, max_pages: int = 100) -> DataFrame:
    """Of numbered pages of each address, those that a reader gets: up to the first that fails, is no list (null items) or is short, and no more than max_pages.

    The last page counts as read. One aggregate by address, joined back; pages after a gap in the numbers aren't reached."""
    stop = ~F.coalesce(success, F.lit(False)) | F.coalesce(items < page_size, F.lit(True))
    last = pages.filter(F.col(page) <= max_pages).groupBy(url).agg(F.min(F.when(stop, F.col(page))).alias("_stop"))
    got = pages.join(last, url).filter((F.col(page) <= max_pages) & (F.col(page) <= F.coalesce("_stop", F.lit(max_pages))))
    return got.drop("_stop")


def rows_to_chunks(df: DataFrame, text: str, metadata: list[str], size: int = 500, source: str = "database") -> DataFrame:
    """Rows as chunks of fixed width without overlap; a null text is the string None, blank ones go, chunk_index only where a row was cut."""
    whole = df.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("None"))).filter(F.col("_t").rlike("(?U)\\S"))
    meta = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in metadata])) if metadata else F.create_map().cast("map<string,string>")
    parts = whole.select(meta.alias("_m"), (F.length("_t") > size).alias("_cut"), F.inline(windows(F.col("_t"), size)))
    return parts.select(F.col("chunk").alias("text"), F.lit(source).alias("source"), F.when(F.col("_cut"), F.map_concat("_m", F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")))).otherwise(F.col("_m")).alias("metadata"), F.lit(1.0).alias("quality_score"))


class _Text(HTMLParser):
    """Visible text, a line each node; the title apart. An element that is left out and never closed ends with the page, as for a parser that builds a tree."""

    SKIP = {"script", "style", "nav", "footer", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.in_title, self.lines, self.title = 0, False, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        self.in_title = self.in_title or tag == "title"

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIP and self.depth > 0
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.depth and data.strip():
            self.lines.append(data.strip())


def html_text(html: str | None) -> tuple[str, str]:
    """(title, text); what isn't HTML passes through."""
    if not html or "<" not in html:
        return "", html or ""
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.title).strip(), "\n".join(p.lines)


def _per_row(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """Rows that a Python function gives for each row, by Arrow batches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # Python strings of a whole batch would take many times its memory
                part = batch.slice(at, ROWS)
                rows = [x for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in make(*values)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=kinds)
            batch = part = rows = None
            release()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    names = kinds.names
    return df.select(*columns).mapInArrow(run, schema)


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of HTML pages."""
    return _per_row(pages, ["page_id", "url", "html"], lambda i, u, h: [(i, u, *html_text(h))], "page_id long, url string, title string, text string")


def _iso(text: str | None) -> datetime | None:
    try:
        d = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return d if d.tzinfo else d.replace(tzinfo=UTC)


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element, *names: str) -> str | None:
    """Text of the first child of a name, the first name that has some winning."""
    for n in names:
        for c in e:
            if _name(c) == n and (c.text or "").strip():
                return c.text.strip()
    return None


def sitemap_urls(xml: str | None) -> list[tuple]:
    """(kind, loc, lastmod, changefreq, priority) of a urlset or an index; nothing for what can't be parsed."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out = []
    for e in root:
        if _name(e) in ("url", "sitemap") and (loc := _child(e, "loc")):
            p = _child(e, "priority")
            try:
                rank = float(p) if p else None
            except ValueError:
                rank = None
            out.append((_name(e), loc, _iso(_child(e, "lastmod")), _child(e, "changefreq"), rank))
    return out


def read_sitemaps(df: DataFrame, xml: str = "xml", max_urls: int | None = 10_000) -> DataFrame:
    """One row an entry, of each document the first max_urls, or all for None."""
    return _per_row(df, [xml], lambda x: sitemap_urls(x)[:max_urls], "kind string, loc string, lastmod timestamp, changefreq string, priority double")


def feed_items(xml: str | None) -> list[tuple]:
    """(title, link, content, published, author, categories) of RSS 2.0 items or Atom entries."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    atom = _name(root) == "feed"
    out = []
    for e in root.iter():
        if _name(e) != ("entry" if atom else "item"):
            continue
        link = next((c.get("href") for c in e if _name(c) == "link" and c.get("href")), None) if atom else _child(e, "link")
        stamp = _child(e, "updated", "published") if atom else _child(e, "pubDate")
        when = _iso(stamp)
        if when is None and stamp:
            try:
                when = parsedate_to_datetime(stamp)
            except (TypeError, ValueError):
                when = None
        kinds = [c.get("term") if atom else (c.text or "").strip() for c in e if _name(c) == "category"]
        out.append((_child(e, "title") or "", link or "", _child(e, *(("content", "summary") if atom else ("encoded", "description"))) or "", when, _child(e, "creator") if not atom else next((_child(c, "name") for c in e if _name(c) == "author"), None), [k for k in kinds if k]))
    return out


def read_feeds(df: DataFrame, xml: str = "xml", max_items: int = 100) -> DataFrame:
    return _per_row(df, [xml], lambda x: feed_items(x)[:max_items], "title string, link string, content string, published timestamp, author string, categories array<string>")


def feed_chunks(items: DataFrame, feed_url: str = "") -> DataFrame:
    """Items with content as chunks."""
    meta = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("title", F.col("title")), ("link", F.col("link")), ("published", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss")), ("author", F.col("author")), ("categories", F.array_join("categories", ",")))])), lambda k, v: v.isNotNull() & (v != ""))
    return items.filter(F.col("content").rlike("(?U)\\S")).select(F.col("content").alias("text"), F.coalesce(F.nullif(F.col("link"), F.lit("")), F.lit(feed_url)).alias("source"), meta.alias("metadata"), F.lit(1.0).alias("quality_score"))


def response_score(status: Column, body: Column) -> tuple[Column, Column]:
    """(score, code) of an API response."""
    bad = (status < 200) | (status >= 300)
    empty = F.coalesce(F.trim(body), F.lit("")).isin("", "{}", "[]", "null")
    error = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    failed = F.arrays_overlap(error, F.array(F.lit("error"), F.lit("errors")))
    return F.when(bad, 0.0).when(empty, 0.5).when(failed, 0.3).otherwise(1.0), F.when(bad, "HTTP_ERROR").when(empty, "EMPTY_RESPONSE").when(failed, "API_ERROR")


def fenced_json(answer: Column) -> Column:
    """The JSON of a model's answer without its code fence."""
    return F.trim(F.regexp_replace(F.trim(answer), "^```[A-Za-z]*\\s*|\\s*```$", ""))


def json_or_error(answer: Column) -> Column:
    """The JSON of a model's answer, or an object with the error and the answer."""
    found = fenced_json(answer)
    return F.when(F.get_json_object(found, "$").isNotNull(), found).otherwise(F.to_json(F.struct(F.lit("invalid JSON").alias("error"), answer.alias("raw"))))


def table_score(cells: Column) -> Column:
    """1 - share of empty cells of an array of rows; 0 without any cell."""
    flat = F.flatten(cells)
    hollow = F.size(F.filter(flat, lambda c: c.isNull() | ~c.rlike("(?U)\\S")))
    return F.when(F.size(flat) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - hollow / F.size(flat)))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an explicit order: a partial aggregate instead of a window."""
    return df.groupBy(key).agg(F.min(order).alias(order))
