"""Operator inputs that Spark derives from the given tables.

Every frame here grows with a table: model responses from ``documents``, a
linked site from ``pages``, an entity graph from the order tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.once import compute_once
from corpusloom.operators import documents as docs
from corpusloom.plans import ingest
from corpusloom.session import scratch_path
from corpusloom.sources import files
from corpusloom.sources.tables import spread, table

DIM = 128
SITE_PAGES = 64


# ---------------------------------------------------------------- documents


def filename(doc_id: Column) -> Column:
    """Two in three documents have a file name."""
    return F.when(doc_id % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("doc_"), doc_id.cast("string"), F.lit(".html")))


def metadata() -> Column:
    return docs.document_metadata(filename=filename(F.col("doc_id")), source=F.col("source"), lang=F.col("lang"))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """A file name per page, with endings of all sorts and some missing."""
    n = F.col("page_id")
    ending = (
        F.when(n % 6 == 0, ".PDF")
        .when(n % 6 == 1, ".txt")
        .when(n % 6 == 2, "")
        .when(n % 6 == 3, ".tar.html")
        .when(n % 6 == 4, ".Jpeg")
        .otherwise(".md")
    )
    stem = F.regexp_extract("url", r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1)
    name = F.when(n % 11 != 0, F.concat(F.lit("in/"), stem, ending))
    return table(spark, sf, "pages").select("page_id", name.alias("filename"))


def stored_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a file: most HTML, some of other kinds, some empty."""
    n = F.col("page_id")
    ending = F.when(n % 7 == 0, ".PDF").when(n % 7 == 1, ".htm").when(n % 7 == 2, ".txt").when(n % 7 == 3, "").otherwise(".html")
    name = F.concat(F.lit("page "), n.cast("string"), F.lit(" 100%"), ending)
    content = F.when(n % 10 == 9, F.lit("<html><body></body></html>")).otherwise(F.col("html"))
    path = scratch_path(spark, "files")
    files.write_files(spread(table(spark, sf, "pages")).select(name.alias("filename"), content.alias("content")), path)
    return files.read_files(spark, path)


def arrivals(rows: DataFrame, by: str, parts: int = 3) -> list[DataFrame]:
    """The rows in parts of about the same size, in the order of a column; nulls come first."""
    shares = [(k + 1) / parts for k in range(parts - 1)]
    cuts = rows.agg(F.percentile_approx(by, shares)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    out = []
    for low, high in zip(bounds, bounds[1:]):
        after = F.lit(True) if low is None else F.col(by) > F.lit(low)
        until = F.lit(True) if high is None else F.col(by) <= F.lit(high)
        out.append(rows.where(F.coalesce(after & until, F.lit(low is None))))
    return out


# ---------------------------------------------------------------- responses


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """What a model might return per block of a document, in twelve shapes.

    Entities: the first letters of every sentence of the block, the source and
    the language; some names repeat, some relations name nothing known, repeat,
    or loop. Each sentence is followed by the next one.
    """
    prompts = ingest.block_prompts(spread(table(spark, sf, "documents")).select("doc_id", "text"))
    about = table(spark, sf, "documents").select("doc_id", "lang", "source")
    opening = F.transform(tx.sentence_array(F.col("block")), lambda s: F.lower(F.substring(s, 1, 3)))
    rows = compute_once(prompts.select("doc_id", "block_index", "block"), ["doc_id", "block_index"], o=opening).join(about, "doc_id")
    n = F.col("doc_id") + F.col("block_index")

    def entity(name, kind, description):
        return F.to_json(F.struct(name.alias("name"), F.lit(kind).alias("type"), description.alias("description")))

    def relation(source, target, kind):
        return F.to_json(F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type")))

    source, lang, o = F.col("source"), F.col("lang"), F.col("o")
    first = F.coalesce(F.get(o, F.lit(0)), F.lit("untitled"))
    openings = F.array_join(F.transform(o, lambda x: entity(x, "opening", F.concat(F.lit("in "), lang))), ",")
    following = F.array_join(
        F.transform(F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))), lambda x, i: relation(F.get(o, i), x, "followed_by")), ","
    )
    entities = F.concat_ws(
        ",",
        entity(source, "source", F.concat(F.lit("documents in "), lang)),
        entity(lang, "language", F.concat(F.lit("language of "), source)),
        F.nullif(openings, F.lit("")),
        F.when(n % 5 == 0, entity(source, "source", F.concat(F.lit("again "), source))),
        F.when(n % 12 == 5, F.lit('{"name":"no description","type":"x"}')),
        F.when(n % 12 == 6, F.lit('{"name":7,"type":"x","description":"number"}')),
    )
    relations = F.concat_ws(
        ",",
        relation(first, source, "published_in"),
        relation(first, lang, "written_in"),
        relation(source, lang, "uses"),
        F.nullif(following, F.lit("")),
        F.when(n % 3 == 0, relation(first, F.lit("Nowhere"), "mentions")),
        F.when(n % 4 == 0, relation(first, source, "published_in")),
        relation(source, source, "self"),
        F.when(n % 12 == 7, F.lit('{"source":"x","type":"lost"},"loose",null')),
        F.when(n % 12 == 8, F.lit('{"source":"x","target":3,"type":"number"}')),
    )
    rows = compute_once(rows, ["doc_id", "block_index"], e=entities, r=relations)
    e, r = F.col("e"), F.col("r")
    body = (
        F.when(n % 12 == 9, F.concat(F.lit('{"entities":['), e, F.lit("]}")))
        .when(n % 12 == 10, F.concat(F.lit('{"entities":['), e, F.lit('],"relations":null}')))
        .when(n % 12 == 11, F.concat(F.lit('{"model":{"v":1},"entities":['), e, F.lit('],"relations":['), r, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"entities":['), e, F.lit('],"relations":['), r, F.lit("]}")))
    )
    response = (
        F.when(n % 12 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\nsee {above}")))
        .when(n % 12 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .when(n % 12 == 3, F.lit("nothing found"))
        .when(n % 12 == 4, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    return rows.select("doc_id", "block_index", response.alias("response"))


# -------------------------------------------------------------------- graph


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, suppliers and parts as entities."""

    def rows(name, key, label, kind, description):
        return table(spark, sf, name).select(
            F.concat(F.lit(kind + "/"), F.col(key).cast("string")).alias("entity_id"),
            F.col(label).alias("name"),
            F.lit(kind).alias("type"),
            description.alias("description"),
        )

    return (
        rows("region", "r_regionkey", "r_name", "region", F.concat(F.lit("the region "), F.col("r_name")))
        .unionByName(
            rows("nation", "n_nationkey", "n_name", "nation", F.concat(F.lit("nation number "), F.col("n_nationkey").cast("string")))
        )
        .unionByName(
            rows("supplier", "s_suppkey", "s_name", "supplier", F.concat(F.lit("supplier in nation "), F.col("s_nationkey").cast("string")))
        )
        .unionByName(rows("part", "p_partkey", "p_name", "part", F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"))))
    )


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """Edges in arrival order: supplies (with repeats), located_in, part_of,
    borders (with loops) and lives_in (of customers, who are no entities)."""

    def node(kind, key):
        return F.concat(F.lit(kind + "/"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))

    def rows(df, source, target, kind, seq):
        return df.select(
            source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), seq.cast("long").alias("seq")
        )

    line = table(spark, sf, "lineitem")
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    supplies = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << 22) + F.col("l_partkey")
    neighbour = F.col("n_nationkey") * 7 % 25
    return (
        rows(line, node("supplier", "l_suppkey"), node("part", "l_partkey"), "supplies", supplies)
        .unionByName(rows(supplier, node("supplier", "s_suppkey"), node("nation", "s_nationkey"), "located_in", F.lit(0)))
        .unionByName(rows(nation, node("nation", "n_nationkey"), node("region", "n_regionkey"), "part_of", F.lit(1)))
        .unionByName(rows(nation, node("nation", "n_nationkey"), node("nation", neighbour), "borders", F.lit(2)))
        .unionByName(
            rows(
                table(spark, sf, "customer"), node("customer", "c_custkey"), node("nation", "c_nationkey"), "lives_in", F.lit(3)
            )
        )
    )


# ------------------------------------------------------------------ vectors


def label_centres(spark: SparkSession, sf: str) -> DataFrame:
    """One question vector per label: the mean of its vectors."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(F.transform(rows, lambda r: r["x"]).alias("embedding")).withColumnRenamed(
        "label", "query_id"
    )


# --------------------------------------------------------------------- site


def site(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as sites of up to 64 linked pages each: a binary tree with
    links home, to another host, to a file, to a fragment, and empty pages."""
    n = F.col("page_id")
    i = n % SITE_PAGES
    host = F.concat(F.lit("http://site"), F.floor(n / SITE_PAGES).cast("string"), F.lit(".example.org"))
    anchors = F.format_string(
        '<p><a class="x" href="/p/%d">down</a><A HREF=\'%d\'>down</A><a href=../p/0>home</a>'
        '<a href="http://other.example.com/p/1">out</a><a href="/files/a.PDF">file</a>'
        '<a href="#part">here</a><a name="none">no</a></p>',
        2 * i + 1,
        2 * i + 2,
    )
    html = F.when(i % 10 == 9, F.lit("<html><body></body></html>")).otherwise(F.concat("html", anchors))
    return spread(table(spark, sf, "pages")).select(
        "page_id", F.concat(host, F.lit("/p/"), i.cast("string")).alias("url"), html.alias("html")
    )


def site_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The home page of every site starts one crawl."""
    return (
        site(spark, sf)
        .where(F.col("url").endswith("/p/0"))
        .select(F.col("page_id").alias("crawl_id"), "url")
    )
