"""Sitemap files as tables: locations in document order, nested indexes, size verdicts, inventory and URL lists."""

from __future__ import annotations

import itertools
import xml.parsers.expat
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathsieve.operators.upserts import checkpointed

#: Bytes in which the beginning of a sitemap must show, and rows a task sends at once.
PREAMBLE_BYTES, ROWS = 500, 20_000
#: Bytes read at once, bytes that a file may inflate to, characters of a location, and locations of a file that a task holds.
PIECE, INFLATED_BYTES, LOC_CHARS, HELD = 1 << 16, 1 << 32, 1 << 16, 50_000
#: Roots of sitemaps and their entries (fixed values).
ENTRIES = {"urlset": "url", "sitemapindex": "sitemap"}
#: Beginnings of a sitemap (fixed values).
STARTS = ("<?xml", "<urlset", "<sitemapindex")
#: Names in the seeded corpus (fixed values).
CATEGORIES, STATIC_PAGES, SECTIONS = ("tools", "parts", "fasteners", "seals", "bearings"), ("/about", "/contact", "/terms", "/privacy", "/shipping"), 300
SCHEMA = "file_url string, root_element string, ordinal int, loc string, had_preamble boolean, error string"


class Unreadable(Exception):
    """Why a file has no locations; the text begins with a code."""


def _recognised(head: bytes) -> bool:
    """Whether a file begins as a sitemap does, in either case."""
    return head.decode("utf-8", "replace").lstrip("\ufeff \t\r\n\v\f").lower().startswith(STARTS)


def _inflated(raw: bytes, most: int) -> Iterator[bytes]:
    """The bytes of a file in pieces of at most ``PIECE``, inflated if they are gzip by content, whatever the file is called."""
    if raw[:2] != b"\x1f\x8b":
        for at in range(0, len(raw), PIECE):
            yield raw[at : at + PIECE]
        return
    rest, size = memoryview(raw), 0
    while len(rest):
        member = zlib.decompressobj(31)
        while not member.eof:
            taken = rest[:PIECE]
            rest = rest[len(taken) :]
            if not taken and not member.unconsumed_tail:
                raise Unreadable("GZIP: the file ends too soon")
            try:
                piece = member.decompress(member.unconsumed_tail + bytes(taken), PIECE)
            except zlib.error as e:
                raise Unreadable(f"GZIP: {e}") from e
            size += len(piece)
            if size > most:
                raise Unreadable(f"INFLATED_TOO_LARGE: more than {most} bytes")
            if piece:
                yield piece
        # another member follows, or zeros that pad the last one
        at = len(raw) - len(rest) - len(member.unused_data)
        while at < len(raw) and not raw[at]:
            at += 1
        rest = memoryview(raw)[at:]


class Locations:
    """The locations of one sitemap, read in pieces: ``parts`` can be run through again, and holds no more than a piece of the file.

    After a run root, had_preamble and error say what the file was.
    """

    def __init__(self, raw: bytes, most: int | None = None):
        self.raw, self.most = raw, INFLATED_BYTES if most is None else most
        self.root: str | None = None
        self.had_preamble, self.error = False, None

    def parts(self) -> Iterator[list[str]]:
        self.root, self.had_preamble, self.error = None, False, None
        path: list[str] = []
        text: list[str] = []
        found: list[str] = []
        wanted = length = 0

        def start(name: str, _: dict) -> None:
            nonlocal wanted, length
            local = name.rpartition(":")[2].lower()
            if not path:
                self.root = local
            path.append(local)
            wanted = local == "loc" and len(path) == 3 and path[1] == ENTRIES.get(path[0])
            length = 0
            text.clear()

        def said(data: str) -> None:
            nonlocal length
            if wanted:
                length += len(data)
                if length > LOC_CHARS:
                    raise Unreadable(f"LOC_TOO_LONG: more than {LOC_CHARS} characters")
                text.append(data)

        def end(_: str) -> None:
            nonlocal wanted
            if wanted:
                loc = "".join(text).strip()
                if loc:
                    found.append(loc)
            path.pop()
            wanted = False
            text.clear()

        parser = xml.parsers.expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
        try:
            for piece in self._markup(_inflated(self.raw, self.most)):
                parser.Parse(piece, False)
                if found:
                    yield found
                    found.clear()
            parser.Parse(b"", True)
        except xml.parsers.expat.ExpatError as e:
            self.error = f"MALFORMED_XML: {e}"
        except Unreadable as e:
            self.error = str(e)
        else:
            if self.root not in ENTRIES:
                self.error = f"WRONG_ROOT: {self.root}"

    def _markup(self, pieces: Iterator[bytes]) -> Iterator[bytes]:
        """The file from its first tag on."""
        head = b""
        while len(head) < 2 * PREAMBLE_BYTES and (piece := next(pieces, None)) is not None:
            head += piece
        first = head[:PREAMBLE_BYTES].find(b"<")
        if _recognised(head[:PREAMBLE_BYTES]):
            yield head.removeprefix(b"\xef\xbb\xbf").lstrip()
        elif first == 0:  # a tag, if an unknown one: the parser says what it is
            yield head
        elif first > 0 and _recognised(head[first : first + PREAMBLE_BYTES]):  # junk goes only when a sitemap is left
            self.had_preamble = True
            yield head[first:]
        else:
            raise Unreadable("NON_XML_PREAMBLE")
        yield from pieces


def locations(raw: bytes) -> tuple[str | None, list[str], bool, str | None]:
    """(root, locations, had_preamble, error) of one file. An error leaves no locations: a part of a file is never an answer."""
    file = Locations(raw)
    found = [loc for part in file.parts() for loc in part]
    return file.root, [] if file.error else found, file.had_preamble, file.error


def read_sitemaps(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """One row for each location of each file under ``path``; a file without any gives one row without ordinal.

    A file is one task's work, whose memory is the file as it is stored and
    ``HELD`` locations, whatever it inflates to; beyond ``most`` bytes
    (``INFLATED_BYTES``) it is an error.
    """
    return parse_sitemaps(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), most)


def parse_sitemaps(files: DataFrame, most: int | None = None) -> DataFrame:
    most, held_at_most, size = INFLATED_BYTES if most is None else most, HELD, ROWS

    def rows(url: str, raw: bytes) -> Iterator[tuple]:
        file, held, n = Locations(raw, most), [], 0
        for part in file.parts():
            n += len(part)
            # a file is told by its end: what is too much to hold is read again then
            held = held + part if n <= held_at_most else []
        if file.error or not n:
            yield url, file.root, None, None, file.had_preamble, file.error
            return
        found = iter(held) if n <= held_at_most else (loc for part in Locations(raw, most).parts() for loc in part)
        for i, loc in enumerate(found):
            yield url, file.root, i, loc, file.had_preamble, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = (row for url, raw in pdf[["path", "content"]].itertuples(index=False) for row in rows(url, bytes(raw or b"")))
            while part := list(itertools.islice(each, size)):
                yield pd.DataFrame(part, columns=["file_url", "root_element", "ordinal", "loc", "had_preamble", "error"]).astype({"ordinal": "Int32"})

    return files.mapInPandas(run, SCHEMA)


def expand_sitemap_indexes(entry: DataFrame, locs: DataFrame, file_limit: int = 50_000) -> DataFrame:
    """Files reached from ``entry`` (file_url) through indexes in ``locs``: (file_url, depth, status, reason, children).

    Breadth first, in the order in which indexes name their children; a file is
    reached once, so cycles end. An expanded index is skipped as
    ``NESTED_SITEMAP_INDEX``; an entry index without children is degraded as
    ``SUSPICIOUSLY_EMPTY_INDEX``. The first index whose children would bring the
    files over ``file_limit`` is skipped as ``NESTED_SITEMAP_INDEX_OVER_LIMIT``,
    with their number, and none of them is reached; the walk ends there and what
    comes after it stays pending. A level is two joins; no level has more files
    than the limit.
    """
    order = F.coalesce(F.col("ordinal"), F.lit(0)) if "ordinal" in locs.columns else F.lit(0)
    named = locs.where("root_element = 'sitemapindex' and loc is not null").groupBy(F.col("file_url").alias("parent"), F.col("loc").alias("file_url")).agg(F.min(order).alias("at"))
    indexes = locs.where("root_element = 'sitemapindex'").groupBy("file_url").agg(F.count_distinct("loc").alias("children"))
    level = entry.groupBy("file_url").agg(F.lit(0).alias("depth"))
    level = checkpointed(level.withColumn("place", F.row_number().over(Window.orderBy("file_url")).cast("long")).join(indexes, "file_url", "left"))
    seen, depth, total = level, 0, level.count()
    over: tuple[str, int] | None = None
    while True:
        depth += 1
        parents = level.where("children is not null").select(F.col("file_url").alias("parent"), F.col("place").alias("parent_place"), "children")
        found = named.join(parents, "parent").join(seen.select("file_url"), "file_url", "left_anti")
        first = found.groupBy("file_url").agg(F.min(F.struct("parent_place", "at", "parent")).alias("by")).select("file_url", "by.*")
        new = parents.join(first.groupBy("parent").agg(F.count("*").alias("new")), "parent", "left").withColumn("new", F.coalesce("new", F.lit(0)))
        before = F.coalesce(F.sum("new").over(Window.orderBy("parent_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        stop = new.withColumn("would", F.lit(total) + before + F.col("children")).where((F.col("would") > file_limit) & (F.col("children") > 0)).agg(F.min(F.struct("parent_place", "parent")).alias("at")).first()["at"]
        if stop is not None:
            over = (stop.parent, stop.parent_place)
            first = first.where(F.col("parent_place") < stop.parent_place)
        place = F.row_number().over(Window.orderBy("parent_place", "at", "file_url")).cast("long") + F.lit(total)
        level = checkpointed(first.select("file_url", F.lit(depth).alias("depth"), place.alias("place")).join(indexes, "file_url", "left"))
        n = level.count()
        seen, total = seen.unionByName(level), total + n
        if over or not n:
            break
    empty = (F.col("children") == 0) & (F.col("depth") == 0)
    reached = F.lit(True) if over is None else F.col("place") < over[1]
    limit = F.lit(False) if over is None else F.col("file_url") == over[0]
    expanded = F.col("children").isNotNull() & reached
    return seen.select(
        "file_url", "depth", F.when(limit, "skipped").when(empty & reached, "degraded").when(expanded, "skipped").otherwise("pending").alias("status"),
        F.when(limit, "NESTED_SITEMAP_INDEX_OVER_LIMIT").when(empty & reached, "SUSPICIOUSLY_EMPTY_INDEX").when(expanded, "NESTED_SITEMAP_INDEX").alias("reason"),
        F.when(limit | expanded, F.col("children")).alias("children"),
    )


def assess_size(files: DataFrame, soft_urls: float | None = None, hard_urls: float | None = None, hard_files: int = 50_000) -> DataFrame:
    """One row: verdict, reason and sampling multiplier of a run's size; files are judged first."""
    inf = float("inf")
    soft, hard = F.lit(soft_urls if soft_urls is not None else inf), F.lit(hard_urls if hard_urls is not None else inf)
    totals = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("url_count"), F.lit(0)).alias("urls"))
    reason = F.when(F.col("files") > hard_files, "HARD_LIMIT_FILES").when(F.col("urls") > hard, "HARD_LIMIT_URLS").when(F.col("urls") > soft, "OVERSIZE_SOFT_LIMIT")
    return totals.withColumn("reason", reason).withColumns({
        "verdict": F.when(F.col("reason").isNull(), "ok").when(F.col("reason") == "OVERSIZE_SOFT_LIMIT", "degraded").otherwise("stop"),
        "sample_multiplier": F.when(F.col("reason") == "OVERSIZE_SOFT_LIMIT", F.greatest(F.lit(0.1), soft / F.col("urls"))).otherwise(F.lit(1.0)),
    })


def read_url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, url): the trimmed non-blank lines of a text, numbered from 0. ``lines`` has one text a row and may have an id column ``file_id``."""
    ids = [c for c in ("file_id",) if c in lines.columns]
    each = lines.select(*ids, F.posexplode(F.split(column, r"\r?\n")).alias("line", "raw"))
    return each.select(*ids, "line", F.trim("raw").alias("url")).where("url <> ''")


def line_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    each = lines.select(F.explode(F.split(column, r"\r?\n")).alias("raw"))
    blank = F.trim("raw") == ""
    return each.agg(F.count("*").alias("submitted"), F.count_if(blank).alias("blank"), F.count_if(~blank).alias("analysed"))


def file_inventory(files: DataFrame, locs: DataFrame) -> DataFrame:
    """Size, digest, compression, locations and parse status of each file (path, content)."""
    counts = locs.groupBy(F.col("file_url").alias("path")).agg(F.count("loc").alias("url_count"), F.max("error").alias("parse_error"))
    own = files.select("path", F.octet_length("content").alias("byte_size"), F.sha2("content", 256).alias("sha256"), (F.hex(F.substring("content", 1, 2)) == "1F8B").alias("is_gzip"))
    return own.join(counts, "path", "left").withColumn("parse_status", F.when(F.col("parse_error").isNotNull(), "failed").when(F.col("url_count").isNull(), "pending").otherwise("parsed"))


def generate_url_corpus(spark: SparkSession, n: int, seed: int = 42, per_file: int = 50_000) -> DataFrame:
    """(file_id, ordinal, loc): a seeded corpus of seven weighted families of URLs, made where it is used."""
    def draw(k: int, below: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(below))

    def one_of(k: int, names: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), (draw(k, len(names)) + 1).cast("int"))

    share, number = draw(0, 100), F.col("id").cast("string")
    category = one_of(1, CATEGORIES)
    path = (
        F.when(share < 55, F.concat(F.lit("/part/"), (F.col("id") + 100_000).cast("string"))).when(share < 75, F.concat(F.lit("/shop/"), category, F.lit("/"), number))
        .when(share < 85, F.concat(F.lit("/section-"), draw(2, SECTIONS).cast("string"), F.lit("/page/"), number))
        .when(share < 93, F.concat(F.lit("/search?q=item-"), number, F.lit("&page="), F.pmod("id", F.lit(20)).cast("string")))
        .when(share < 95, F.concat(F.lit("/legacy/discontinued/"), number))
        .when(share < 98, F.concat(F.lit("/catalog/"), category, F.lit("/"), F.pmod("id", F.lit(500)).cast("string"), F.lit("/detail/"), number)).otherwise(one_of(3, STATIC_PAGES))
    )
    return spark.range(n).select(F.floor(F.col("id") / per_file).cast("int").alias("file_id"), F.pmod("id", F.lit(per_file)).cast("int").alias("ordinal"), F.concat(F.lit("https://example.com"), path).alias("loc"))
