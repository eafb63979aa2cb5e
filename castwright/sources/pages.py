"""Scraped pages and exported packages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright.functions.numbers import publication_day

# Fixed value: a host that delivers audio.
AUDIO_HOST = "media.xyzcdn.net"
AUDIO = r"(?i)\.(?:mp3|m4a|wav|ogg)"


def read_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, stem, text`` of whole text files whose names match."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.substring_index(F.input_file_name(), "/", -1)
    return files.select(F.input_file_name().alias("path"), F.regexp_replace(name, r"(?:_diarized)?\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))


def read_segments_json(spark: SparkSession, path: str) -> DataFrame:
    """Segments of JSON files; a corrupt file gives no rows."""
    schema = "text string, start_time double, end_time double, speaker string, _corrupt_record string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def episode_id_of(url: Column) -> Column:
    """The id behind /episode/ in a page's address; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"/episode/([0-9a-zA-Z]+)", 1), F.lit(""))


def looks_like_audio(url: Column) -> Column:
    """An audio extension anywhere in an address, or the host that delivers audio."""
    return F.coalesce(url.rlike(AUDIO) | F.contains(url, F.lit(AUDIO_HOST)), F.lit(False))


def audio_extension(url: Column) -> Column:
    """The extension of an audio address without its query; .mp3 if it has none."""
    bare = F.substring_index(F.substring_index(F.coalesce(url, F.lit("")), "?", 1), "#", 1)
    found = F.lower(F.regexp_extract(bare, r"(\.(?:mp3|m4a|wav|ogg|aac|flac))$", 1))
    return F.when(found == "", ".mp3").otherwise(found)


def podcast_of(title: Column, site: Column) -> Column:
    """What follows the first ' - ' of a title, else the site's name."""
    return F.when(F.instr(title, " - ") > 0, F.element_at(F.split(title, " - ", 2), 2)).otherwise(site)


def meta(html: Column, prop: str) -> Column:
    """The content of a meta tag by property, else by name; null if it is missing or blank."""
    by = lambda attr: F.nullif(F.trim(F.regexp_extract(html, rf'(?is)<meta[^>]*{attr}=["\']{prop}["\'][^>]*content=["\']([^"\']*)["\']', 1)), F.lit(""))
    return F.coalesce(by("property"), by("name"))


def ld_objects(html: Column) -> Column:
    """array<variant> of the objects of a page's JSON-LD: those of each block, of lists, and of two levels of '@graph'; bad JSON is passed over."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull())
    none = F.array().cast("array<variant>")
    listed = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    graph = lambda objects: F.flatten(F.transform(objects, lambda v: F.concat(F.array(v), F.coalesce(F.try_variant_get(v, "$.@graph", "array<variant>"), none))))
    return F.filter(graph(graph(listed)), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def _first(objects: Column, value) -> Column:
    """The first value that an object gives."""
    return F.get(F.filter(F.transform(objects, value), lambda x: x.isNotNull()), F.lit(0))


def _field(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths])


def text_between(html: Column, pattern: str) -> Column:
    """The text of the first match without tags; null if it is blank."""
    bare = F.regexp_replace(F.regexp_extract(html, pattern, 1), r"(?s)<[^>]*>", " ")
    return F.nullif(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit(""))


def scan_pages(pages: DataFrame) -> DataFrame:
    """Episodes of page HTML (``url, html``): each field from JSON-LD, then meta tags, then the page itself; pages without audio are left out.

    The episode is the first object of type PodcastEpisode; the date is its own, or the first of any object.
    """
    html = F.col("html")
    p = pages.withColumn("__o", ld_objects(html)).withColumn("__e", F.get(F.filter("__o", lambda v: F.try_variant_get(v, "$.@type", "string") == "PodcastEpisode"), F.lit(0)))
    ld = lambda *paths: _field(F.col("__e"), *paths)
    heard = lambda v: F.coalesce(*[F.when(looks_like_audio(_field(v, x)), _field(v, x)) for x in ("$.associatedMedia.contentUrl", "$.associatedMedia.url", "$.audio", "$.contentUrl", "$.url")])
    day = lambda v: publication_day(_field(v, "$.datePublished", "$.dateCreated", "$.pubDate"))
    graph = F.when(F.col("__e").isNotNull(), F.concat(F.array("__e"), F.coalesce(F.try_variant_get("__e", "$.@graph", "array<variant>"), F.array().cast("array<variant>"))))
    title = F.coalesce(ld("$.name"), meta(html, "og:title"), text_between(html, r"(?is)<title[^>]*>(.*?)</title>"))
    notes = text_between(html, r'(?is)<(?:div|section|article|p)[^>]*class=["\'][^"\']*(?:show.?notes|description|content)[^"\']*["\'][^>]*>(.*?)</(?:div|section|article|p)>')
    return p.select(
        episode_id_of(F.col("url")).alias("episode_id"), "url", title.alias("title"),
        F.coalesce(ld("$.partOfSeries.name"), meta(html, "og:site_name"), podcast_of(title, F.lit(None).cast("string"))).alias("podcast_name"),
        F.coalesce(day(F.col("__e")), _first(F.col("__o"), day)).alias("pub_date"), F.coalesce(ld("$.description"), meta(html, "og:description"), notes).alias("show_notes"),
        F.coalesce(_first(graph, heard), meta(html, "og:audio")).alias("audio_url"), meta(html, "og:image").alias("cover_url"),
    ).where("audio_url is not null and episode_id is not null")


def parse_packages(packages: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, title, source, notes, transcript`` of session packages."""
    t = F.col(text)
    part = lambda pattern: F.trim(F.regexp_extract(t, pattern, 1))
    return packages.select(key, part(r"(?m)^# ([^\n]*)").alias("title"), part(r"(?m)^> 来源：([^\n]*)").alias("source"), part(r"(?s)\n# Show Notes[^\n]*\n(.*?)(?=\n# 转录全文|\z)").alias("notes"), part(r"(?s)\n# 转录全文[^\n]*\n(.*)\z").alias("transcript"))


def package_segments(parsed: DataFrame, key: str = "path") -> DataFrame:
    """``key, no, label, text`` of a package's labelled lines; a line without label belongs to the one before it."""
    turns = F.split("transcript", r"(?m)\n(?=\[[^\]\n]+\])")
    return parsed.select(key, F.posexplode(turns).alias("no", "turn")).select(key, "no", F.regexp_extract("turn", r"^\[([^\]\n]+)\]", 1).alias("label"), F.trim(F.regexp_replace("turn", r"^\[[^\]\n]+\]\s*", "")).alias("text")).where("text <> ''")


def package_text(title: Column, source: Column, notes: Column, transcript: Column) -> Column:
    """The text of a session package."""
    return F.concat(F.lit("# "), title, F.lit("\n\n> 来源："), source, F.lit("\n\n# Show Notes\n"), F.when(F.trim(F.coalesce(notes, F.lit(""))) == "", "（无）").otherwise(notes), F.lit("\n\n# 转录全文\n"), transcript)
