"""Sources: strict JSON and CSV, checkpoints, archives, files by hash, foreign schemas."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship_package

SOURCE = "id string, title string, url string"
RECIPE = f"id string, name string, ingredients array<string>, seasonings array<string>, minutes int, tags array<string>, steps array<string>, source struct<{SOURCE}>, images array<string>, videos array<string>"
DOCUMENT = f"schema_version int, dataset struct<id string, name string, is_demo boolean, description string, source string, license string>, ingredient_aliases map<string,string>, recipes array<struct<{RECIPE}>>"
NODE_CSV, EDGE_CSV = "id string, label string, properties_json string", "id string, start_id string, end_id string, type string, properties_json string"


def document(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file of recipes; a malformed file is an error."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def recipes(documents: DataFrame) -> DataFrame:
    """A row for each recipe; lists lose repetitions (order kept) but steps keep theirs."""
    rows = documents.select(F.explode("recipes").alias("r")).select("r.*")
    return rows.withColumns({c: F.array_distinct(c) for c in ("ingredients", "seasonings", "tags", "images", "videos")})


def canonical_recipes(documents: DataFrame) -> DataFrame:
    """Recipes with their ingredients under the canonical names of their own document."""
    named = lambda m, x: F.coalesce(F.try_element_at(m, x), x)
    rows = documents.select("ingredient_aliases", F.explode("recipes").alias("r")).select("ingredient_aliases", "r.*")
    rows = rows.withColumns({c: F.array_distinct(c) for c in ("ingredients", "seasonings", "tags", "images", "videos")})
    own = F.coalesce("ingredient_aliases", F.create_map().cast("map<string,string>"))
    return rows.withColumn("ingredients", F.array_distinct(F.transform("ingredients", lambda x: named(own, x)))).drop("ingredient_aliases")


def recipe_violations(rows: DataFrame) -> DataFrame:
    """(id, reason) of recipes without id, name, steps or source, with blank members, minutes below one, or a repeated id."""
    from ..operators.audit import violations

    blank = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    rules = {"id": filled(F.col("id")), "name": filled(F.col("name")), "steps": F.size(F.coalesce("steps", F.array().cast("array<string>"))) > 0, "blank_member": ~(blank("ingredients") | blank("seasonings") | blank("tags") | blank("steps")), "minutes": F.col("minutes").isNull() | (F.col("minutes") >= 1), "source": filled(F.col("source.id")) & filled(F.col("source.title"))}
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("reason"))
    return violations(rows, "id", rules).union(repeated)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are passed over and a malformed one is an error. Gzip files are read alike."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def newest_form(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a folder in which a plain file takes the place of a gzip file of the same name."""
    files = spark.read.format("binaryFile").load(path).select("path")  # names only: the content column is not read
    chosen = files.select("path", F.regexp_replace("path", r"\.gz$", "").alias("plain")).groupBy("plain").agg(F.min_by("path", F.length("path")).alias("path"))
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumn("__file", F.col("_metadata.file_path")).join(F.broadcast(chosen.select(F.col("path").alias("__file"))), "__file", "left_semi").drop("__file")


def checkpoint_lines(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last record of each key. A torn last line of a file is dropped; one further up is an error.

    Files are read by line and in splits: a line's place is its file, its split's first byte and its row in the task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")).where("trim(value) <> ''")
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).join(F.broadcast(last), "file")  # a row a file
    torn = F.col("r").isNull() | F.col(f"r.{key}").isNull()
    good = parsed.where(~(torn & (F.col("at") == F.col("last")))).withColumn("r", F.when(torn, F.raise_error(F.lit("torn line inside a checkpoint")).cast(parsed.schema["r"].dataType)).otherwise(F.col("r")))
    return good.groupBy(f"r.{key}").agg(F.max_by("r", F.struct("file", "at")).alias("r")).select("r.*")


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header must be the schema's columns; rows that do not fit are an error."""
    wanted = T._parse_datatype_string(schema).names
    found = spark.read.option("header", True).csv(path).columns
    if found != wanted:
        raise ValueError(f"columns {found} where {wanted} were expected")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


@F.udf(T.StringType())
def json_fault(text: str | None) -> str | None:
    """Why a JSON object is refused: malformed, repeated key, or a number that is not finite; null if it is fine."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name):
        raise ValueError(f"number {name}")

    try:
        value = json.loads(text or "", object_pairs_hook=pairs, parse_constant=constant)
    except ValueError as error:
        message = str(error)
        return message if message.startswith(("repeated", "number")) else "malformed"
    return None if isinstance(value, dict) else "no object"


def member_kind(name: Column) -> Column:
    """What an archive member is, by its path and suffix."""
    low = F.lower(name)
    is_ = lambda pattern: low.rlike(pattern)
    return F.when(name.endswith("/"), "directory").when(is_(r"(^|/)goal\.txt$"), "goal").when(is_(r"(^|/)steps\.txt$"), "steps").when(is_(r"\.(jpe?g|png|webp|gif|bmp)$"), "image").when(is_(r"\.(mp4|mov|avi|mkv|webm)$"), "video").when(is_(r"\.txt$"), "text").otherwise("other")


_MEMBERS = "archive string, member string, size long, compressed_size long, crc string, compression int, header_offset long, content binary, fault string"


def archive_members(spark: SparkSession, path: str, texts_only: bool = True) -> DataFrame:
    """A row for each member of the ZIP files under a path, with its bytes where asked for; CRC and size are checked.

    Archives are dealt to tasks whole; entry_end is the byte before the next member begins.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        body, fault = None, None
                        if not i.is_dir() and (not texts_only or i.filename.lower().endswith(".txt")):
                            try:
                                body = z.read(i)
                                if len(body) != i.file_size or zlib.crc32(body) != i.CRC:
                                    fault = "checksum"
                            except (zipfile.BadZipFile, zlib.error, NotImplementedError) as error:
                                fault = type(error).__name__
                        rows.append((archive, i.filename, i.file_size, i.compress_size, f"{i.CRC:08x}", i.compress_type, i.header_offset, body, fault))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBERS.split(", ")])

    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    members = files.mapInPandas(run, _MEMBERS)
    after = F.lead("header_offset").over(Window.partitionBy("archive").orderBy("header_offset"))
    return members.withColumn("entry_end", after - 1).withColumn("kind", member_kind(F.col("member")))


@F.udf(T.StringType())
def gb18030(content: bytes | None) -> str | None:
    try:
        return None if content is None else bytes(content).decode("gb18030")
    except UnicodeDecodeError:
        return None


def decoded(content: Column) -> Column:
    """UTF-8 (a mark at the start dropped), else GB 18030, else null."""
    return F.coalesce(F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", ""), gb18030(content))


def paired_folders(members: DataFrame, limit: int = 0) -> DataFrame:
    """(archive, folder) of folders with both a goal and a steps file, in lexical order; a limit of 0 means all."""
    folder = F.regexp_extract("member", "^(.*?)/?[^/]*$", 1).alias("folder")
    of = lambda kind: members.where(F.col("kind") == kind).select("archive", folder).distinct()
    rows = of("goal").join(of("steps"), ["archive", "folder"]).orderBy("archive", "folder")
    return rows.limit(limit) if limit else rows


def repaired_name(name: Column) -> Column:
    """A member's name whose UTF-8 bytes were read as code page 437; other names as they are."""
    return F.coalesce(_from_cp437(F.when(name.rlike("[^\\x00-\\x7F]"), name)), name)


@F.udf(T.StringType())
def _from_cp437(name: str | None) -> str | None:
    try:
        return None if name is None else name.encode("cp437").decode("utf-8")
    except UnicodeError:
        return None


def records(members: DataFrame) -> DataFrame:
    """Folders with a steps file become records: title from the goal file, numbered steps, media of the folder."""
    from ..functions.text import lines

    folder = F.regexp_extract("member", "^(.*?)/?[^/]*$", 1)
    texts = members.where("kind IN ('goal', 'steps')").select("archive", folder.alias("folder"), "kind", decoded(F.col("content")).alias("t"))
    pivoted = texts.groupBy("archive", "folder").pivot("kind", ["goal", "steps"]).agg(F.first("t"))
    media = members.where("kind IN ('image', 'video')").select("archive", F.regexp_extract("member", "^(.*?)/?[^/]*$", 1).alias("folder"), "kind", "member").groupBy("archive", "folder").agg(F.sort_array(F.collect_list(F.struct("member", "kind"))).alias("media"))
    out = pivoted.join(media, ["archive", "folder"], "full")
    steps = F.coalesce(lines(F.col("steps")), F.array().cast("array<string>"))
    flags = F.filter(F.array(F.when(F.trim(F.coalesce("goal", F.lit(""))) == "", "no_title"), F.when(F.size(steps) == 0, "no_steps")), lambda x: x.isNotNull())
    return out.select("archive", "folder", F.trim("goal").alias("title"), F.transform(steps, lambda s, i: F.struct((i + 1).alias("order"), s.alias("text"))).alias("steps"), F.coalesce("media", F.array().cast("array<struct<member:string,kind:string>>")).alias("media"), flags.alias("quality_flags"))


def read_plan(members: DataFrame, max_gap: int = 16384, max_span: int = 8 << 20) -> DataFrame:
    """Byte ranges to fetch: neighbours closer than max_gap are read together, up to max_span where they allow it."""
    from ..operators.evidence import islands

    rows = islands(members.where("entry_end IS NOT NULL"), ["archive"], "header_offset", "entry_end", F.lit(max_gap), F.col("header_offset"))
    rows = rows.withColumn("part", F.floor((F.col("header_offset") - F.min("header_offset").over(Window.partitionBy("archive", "island"))) / max_span))
    return rows.groupBy("archive", "island", "part").agg(F.min("header_offset").alias("first"), F.max("entry_end").alias("last"), F.count("*").alias("n_members"))


def selection(rows: DataFrame, id_col: str, offset: int = 0, limit: int = 0, only: str | None = None) -> DataFrame:
    """Rows by id: one of them, or those from an offset on; a limit of 0 means all. A repeated id is an error."""
    if not rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{id_col} is not unique")
    if only is not None:
        return rows.where(F.col(id_col) == only)
    out = rows.orderBy(id_col).offset(offset)
    return out.limit(limit) if limit else out


def mapped(rows: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """A foreign table under known names: each the first of its properties that is present and not blank."""
    from ..operators.constraints import first_present

    have = set(rows.columns)
    pick = lambda names: [F.col(n).cast("string") for n in names if n in have] or [F.lit(None).cast("string")]
    return rows.select(*[first_present(*pick(names), blank_is_null=True).alias(to) for to, names in mapping.items()])


def described(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels, relationship types and property names that occur, with their counts."""
    keys = lambda df, what: df.select(F.lit(what).alias("what"), F.explode(F.json_object_keys("properties_json")).alias("name"))
    parts = [nodes.select(F.lit("label").alias("what"), F.col("label").alias("name")), edges.select(F.lit("type").alias("what"), F.col("type").alias("name")), keys(nodes, "node_property"), keys(edges, "edge_property")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("what", "name").agg(F.count("*").alias("n"))


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files under a path whose SHA-256 is not the manifest's (name, sha256), or that only one side knows."""
    found = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    return manifest.select("name", "sha256").join(found, "name", "full").where(~F.col("sha256").eqNullSafe(F.col("found")))


def manifest_differences(table: DataFrame, manifest: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(name, expected, found) of a one-row manifest's fields that the table does not bear out."""
    given = manifest.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("expected")) for n in measures])).alias("x")).select("x.*")
    found = table.agg(*[c.alias(n) for n, c in measures.items()]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("found")) for n in measures])).alias("x")).select("x.*")
    return given.join(found, "name").where(~F.col("expected").eqNullSafe(F.col("found")))


def corpus_violations(docs: DataFrame, id_col: str, text_col: str, sha_col: str, prefix: str = "") -> DataFrame:
    """(id, reason) of a text corpus whose ids are blank, repeated or of another name space, or whose text is not its hash's."""
    from ..operators.audit import violations

    own = F.col(id_col).cast("string")
    rules = {"id": F.length(own) > 0, "name_space": own.startswith(prefix), "text": F.col(text_col).isNotNull(), "hash": F.sha2(F.col(text_col).cast("binary"), 256).eqNullSafe(F.col(sha_col))}
    repeated = docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col, F.lit("repeated").alias("reason"))
    return violations(docs, id_col, rules).union(repeated)


def move_single(spark: SparkSession, folder: str, path: str) -> None:
    """Give the one part file that a folder holds a name of its own."""
    jvm = spark._jvm.org.apache.hadoop.fs
    place, target = jvm.Path(folder), jvm.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in files.listStatus(place) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{len(parts)} part files where one was expected")
    files.mkdirs(target.getParent())
    files.rename(parts[0], target)
