"""Readers: each ``read_*`` opens files, each ``parse_*`` works on a frame of text and holds the rules."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from touchline import schemas
from touchline.operators.text import drop_front_matter
from touchline.session import cut_lineage
from touchline.sources.sinks import file_store

#: Paths or files in a batch at most, and bytes after which a batch of texts is full.
LISTED, HELD_BYTES = 1024, 4 << 20
#: Tasks that list folders at most; files and bytes of a task that reads them.
MOST_LISTERS, TASK_FILES, TASK_BYTES = 1000, 5_000, 64 << 20


# ---- boxes --------------------------------------------------------------------------------------------------

def parse_mot(lines: DataFrame) -> DataFrame:
    """Box lines ``frame, id, left, top, width, height, conf``: ``;`` counts as ``,``; comments and short lines are skipped.

    ``lines`` has sequence_id and value.  Rows of confidence 0 or less go; the corner is floored at 0.
    """
    parts = F.split(F.regexp_replace(F.trim("value"), ";", ","), ",")
    df = lines.filter(~F.trim("value").startswith("#")).withColumn("_p", parts).filter(F.size("_p") >= 6)
    num = lambda i: F.trim(F.get("_p", F.lit(i))).try_cast("double")
    df = df.select("sequence_id", num(0).cast("bigint").alias("frame_index"), num(1).cast("bigint").alias("track_id"), num(2).alias("_l"), num(3).alias("_t"),
                   num(4).alias("_w"), num(5).alias("_h"), F.coalesce(num(6), F.lit(1.0)).alias("conf")).filter("conf > 0")
    zero = F.lit(0.0)
    return df.select("sequence_id", "frame_index", "track_id", F.round(F.greatest(zero, "_l"), 2).alias("x1"), F.round(F.greatest(zero, "_t"), 2).alias("y1"),
                     F.round(F.col("_l") + F.col("_w"), 2).alias("x2"), F.round(F.col("_t") + F.col("_h"), 2).alias("y2"), "conf")


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """``<sequence>/gt/gt.txt`` files; the sequence is the name of the folder above ``gt``."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/gt/[^/]+$", 1)
    return parse_mot(spark.read.text(path).select(name.alias("sequence_id"), "value"))


def _path_ranks(paths: DataFrame) -> DataFrame:
    """Rank of each distinct path: numbered inside ranges of paths, and moved on by the sizes of the ranges before."""
    dealt = cut_lineage(paths.repartitionByRange("path").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("path"))
    return dealt.withColumn("_place", inside).join(before, "_part").select("path", (F.col("_place") + F.col("_before")).cast("bigint").alias("frame_index"))


def parse_yolo(labels: DataFrame, classes: list[str], width: int, height: int) -> DataFrame:
    """Normalised centre boxes to clamped corners; class ``ignored`` goes; the frame is the rank of the sorted path.

    ``labels`` has path and value.  The rank is taken over the distinct paths, not over the rows.
    """
    names = F.array(*[F.lit(c) for c in classes])
    order = _path_ranks(labels.select("path").distinct())
    p = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.get(p, F.lit(i)).try_cast("double")
    df = labels.filter(F.size(p) >= 5).select("path", F.get(names, num(0).cast("int")).alias("class"), num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h"))
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), v))
    cx, cy, w, h = [F.col(c) for c in ("cx", "cy", "w", "h")]
    return (df.filter("class IS NOT NULL AND class <> 'ignored'").join(order, "path")
            .select("frame_index", "class", clamp((cx - w / 2.0) * width, width).alias("x1"), clamp((cy - h / 2.0) * height, height).alias("y1"),
                    clamp((cx + w / 2.0) * width, width).alias("x2"), clamp((cy + h / 2.0) * height, height).alias("y2")))


def read_yolo(spark: SparkSession, path: str, classes: list[str], width: int, height: int) -> DataFrame:
    return parse_yolo(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"), classes, width, height)


def parse_track_roles(lines: DataFrame) -> DataFrame:
    """``trackletID_n = role team;jersey`` lines into track, role, team and jersey; referees and balls have no team."""
    pattern = r"^trackletID_(\d+)\s*=\s*([^;]*);?(.*)$"
    text = F.lower(F.trim(F.regexp_extract("value", pattern, 2)))
    role = (F.when(text.startswith("goalkeeper"), "GOALKEEPER").when(text.startswith("player"), "OUTFIELD_PLAYER").when(text.startswith("referee"), "REFEREE")
            .when(text.startswith("ball"), "BALL").otherwise("OTHER"))
    df = lines.filter(F.col("value").rlike(pattern)).select("sequence_id", F.regexp_extract("value", pattern, 1).cast("bigint").alias("track_id"), text.alias("_t"),
                                                            role.alias("role"), F.trim(F.regexp_extract("value", pattern, 3)).alias("jersey"))
    side = F.when(F.col("role").isin("GOALKEEPER", "OUTFIELD_PLAYER"), F.when(F.col("_t").contains("left"), "left").when(F.col("_t").contains("right"), "right"))
    return df.select("sequence_id", "track_id", "role", side.alias("team"), "jersey")


def read_track_roles(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return parse_track_roles(spark.read.text(path).select(name.alias("sequence_id"), "value"))


# ---- documents ----------------------------------------------------------------------------------------------

def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines of JSON; blank lines give no row."""
    return spark.read.schema(schemas.CHUNK).json(path).filter("text IS NOT NULL")


def globs(pattern: str) -> list[str]:
    """The patterns that a pattern with alternatives in braces stands for."""
    head, brace, rest = pattern.partition("{")
    if not brace:
        return [pattern]
    inner, _, tail = rest.partition("}")
    return [p for x in inner.split(",") for p in globs(f"{head}{x}{tail}")]


def _list_folders(pattern: str):
    """From folders to what lies in them: files that fit the pattern with their sizes, and folders; hidden names are passed over."""
    kinds = globs(pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            store, base = file_store(folder)
            found = [x for x in store.get_file_info(fs.FileSelector(base)) if not x.base_name.startswith((".", "_"))]
            found = [x for x in found if x.type == fs.FileType.Directory or any(fnmatchcase(x.base_name, k) for k in kinds)]
            names = [f"{folder.rstrip('/')}/{x.base_name}" for x in found]
            for i in range(0, len(found), LISTED):
                part = found[i:i + LISTED]
                yield pa.RecordBatch.from_arrays([pa.array(names[i:i + LISTED], pa.string()), pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_()), pa.array([x.size or 0 for x in part], pa.int64())], ["path", "folder", "size"])

    return rows


def list_files(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """``path, size`` of the files in ``folder`` whose names fit ``pattern``, a job for each level of folders.

    A task lists whole folders; no list of files comes to the driver.
    """
    level = spark.createDataFrame([(folder,)], "path string").coalesce(1)
    out = None
    while True:
        found = cut_lineage(level.mapInArrow(_list_folders(pattern), "path string, folder boolean, size long"), "listed")
        files = found.filter("NOT folder").select("path", "size")
        out = files if out is None else out.unionByName(files)
        below = found.filter("folder").select("path")
        deeper = below.count() if recursive else 0
        if not deeper:
            return out
        level = below.repartition(min(deeper, MOST_LISTERS))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, value`` of each file; files that cannot be read are left out, those that have gone meanwhile are an error."""
    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["path", "value"])

    paths, values, held = [], [], 0
    for path in (f for batch in batches for f in batch.column(0).to_pylist()):
        store, at = file_store(path)
        try:
            with store.open_input_stream(at) as f:
                value = f.read()
        except FileNotFoundError:
            raise
        except OSError:
            continue
        paths.append(path)
        values.append(value)
        held += len(value)
        if held >= HELD_BYTES or len(paths) >= LISTED:
            yield packed()
            paths, values, held = [], [], 0
    if paths:
        yield packed()


def read_documents(spark: SparkSession, path: str, pattern: str = "*.{md,txt,html}", recursive: bool = False, keep_front_matter: bool = False) -> DataFrame:
    """One row per text file with its name; front matter is cut when reading a corpus recursively, unless it is to be kept.

    Files are listed and read by the tasks, a few thousand in each: Spark's own file index holds a list of all files on the
    driver, and its readers take milliseconds for each small file. One task lists one folder, so a large corpus needs folders.
    """
    files = list_files(spark, path, pattern, recursive)
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tasks = max(spark.sparkContext.defaultParallelism, total.n // TASK_FILES, total.size // TASK_BYTES)
    raw = files.select("path").repartition(int(tasks)).mapInArrow(_read_files, "path string, value binary").withColumn("value", F.col("value").cast("string"))
    text = drop_front_matter(F.col("value")) if recursive and not keep_front_matter else F.col("value")
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), text.alias("text"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MATCH).option("multiLine", "true").json(path)


# ---- statistics ---------------------------------------------------------------------------------------------

def first_header(columns: list[str], has: tuple[str, ...], lacks: tuple[str, ...] = ()) -> str | None:
    """First header that holds one of ``has`` and none of ``lacks``, letter case ignored."""
    return next((c for c in columns if any(h in c.lower() for h in has) and not any(x in c.lower() for x in lacks)), None)


def season_rows(table: DataFrame, match_id: str, competition: str = "Domestic League") -> DataFrame:
    """Season CSV columns to the statistics columns; a missing column or value counts 0."""
    found = {"xg": first_header(table.columns, ("xg",), ("npxg",)), "xa": first_header(table.columns, ("xag", "xa")),
             "kp": first_header(table.columns, ("kp", "key_pass")), "prgc": first_header(table.columns, ("prgc", "progressive_carries"))}
    number = lambda c, kind: F.coalesce(F.col(f"`{c}`").try_cast(kind), F.lit(0).cast(kind)) if c and c in table.columns else F.lit(0).cast(kind)
    goals, passes = number("Gls", "int"), number(found["kp"], "int")
    text = lambda c: F.coalesce(F.col(c), F.lit("Inconnu")) if c in table.columns else F.lit("Inconnu")
    return table.select(
        F.lit(match_id).alias("match_id"), text("Player").alias("player_name"), number("Min", "int").alias("minutes_played"), goals.alias("goals"),
        number(found["xg"], "double").alias("expected_goals"), number(found["xa"], "double").alias("expected_assists"), passes.alias("key_passes"),
        number(found["prgc"], "int").alias("progressive_dribbles"), (goals * 4 + passes * 2).alias("defensive_pressures"),
        F.lit(competition).alias("competition"), text("Squad").alias("team_name"))


def read_season_csv(spark: SparkSession, path: str, match_id: str) -> DataFrame:
    return season_rows(spark.read.option("header", "true").csv(path), match_id)


def schema_names(names: list[str]) -> list[str]:
    """Column names as given; empty and repeated ones get their place as a name."""
    return [n if n and n not in names[:i] else f"_{i}" for i, n in enumerate(names)]


def read_season_files(spark: SparkSession, path: str, match_id: str) -> DataFrame:
    """Season CSV files of one folder whose headers differ: later files have columns that earlier ones lack, or other names for them.

    The first line of every file is its header. Lines are parsed by the header of their own file, and each header is resolved
    on its own; a column that a file lacks counts 0. What comes to the driver is the list of distinct headers. Fields may be
    quoted but may not hold line breaks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    kinds = [r.header for r in heads.select("header").distinct().orderBy("header").collect()]
    told = lines.join(heads, "file").filter("value <> header AND value <> ''")
    out = None
    for header in kinds:
        names = next(csv.reader([header]))
        rows = told.filter(F.col("header") == header).select(F.from_csv("value", ", ".join(f"`{n}` string" for n in schema_names(names))).alias("r")).select("r.*")
        part = season_rows(rows, match_id)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else season_rows(spark.createDataFrame([], "Player string"), match_id)


def season_code(code: Column) -> Column:
    """Stored match id of a season code; other seasons are left out by the caller."""
    return F.when(code == "2425", "season_2024_2025_cl").when(code == "2526", "season_2025_2026_cl")


def two_level_rows(table: DataFrame) -> DataFrame:
    """Statistics whose headers were joined from two levels as ``Group_Name``; nulls count 0, unknown seasons go."""
    pick = lambda name, kind: next((F.coalesce(F.col(f"`{c}`").try_cast(kind), F.lit(0).cast(kind)) for c in table.columns if c.split("_")[-1] == name), F.lit(0).cast(kind))
    named = lambda name: next((F.col(f"`{c}`") for c in table.columns if c.split("_")[-1].lower() == name), F.lit(None).cast("string"))
    return table.select(season_code(named("season")).alias("match_id"), named("player").alias("player_name"), pick("Min", "int").alias("minutes_played"),
                        pick("Gls", "int").alias("goals"), pick("xG", "double").alias("expected_goals"), named("team").alias("team_name"),
                        F.lit("Champions League").alias("competition")).filter("match_id IS NOT NULL")


def fixtures_to_matches(fixtures: DataFrame) -> DataFrame:
    """Finished fixtures of the API shape to match rows: statistics by name, minute = elapsed plus extra."""
    done = fixtures.filter("fixture.status.short = 'FT'")
    slug = lambda c: F.substring(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), 1, 12)
    home, away = F.col("teams.home.name"), F.col("teams.away.name")
    value = lambda s, name: F.try_element_at(F.transform(F.filter(s["statistics"], lambda x: x["type"] == name), lambda x: F.regexp_replace(x["value"], "%", "")), F.lit(1))
    stat = lambda s: F.struct(F.coalesce(value(s, "Ball Possession").try_cast("double"), F.lit(0.0)).alias("possession_pct"),
                              F.coalesce(value(s, "Total Shots").try_cast("int"), F.lit(0)).alias("shots"),
                              F.coalesce(value(s, "Shots on Goal").try_cast("int"), F.lit(0)).alias("shots_on_target"),
                              F.coalesce(value(s, "expected_goals").try_cast("double"), F.lit(0.0)).alias("xg"))
    listed = F.coalesce("statistics", F.array().cast(dict(fixtures.dtypes)["statistics"]))
    entries = F.transform(listed, lambda s: F.struct(s["team"]["name"].alias("key"), stat(s).alias("value")))
    blank = F.struct(F.lit(0.0).alias("possession_pct"), F.lit(0).alias("shots"), F.lit(0).alias("shots_on_target"), F.lit(0.0).alias("xg"))
    absent = F.transform(F.array_except(F.array(home, away), F.transform(listed, lambda s: s["team"]["name"])), lambda t: F.struct(t.alias("key"), blank.alias("value")))
    events = F.transform(F.coalesce("events", F.array().cast(dict(fixtures.dtypes)["events"])), lambda e: F.struct(
        (e["time"]["elapsed"] + F.coalesce(e["time"]["extra"], F.lit(0))).alias("minute"), e["team"]["name"].alias("team"), e["type"].alias("type"), e["detail"].alias("description")))
    day = F.substring("fixture.date", 1, 10)
    return done.select(
        F.concat_ws("_", F.regexp_replace(day, "-", "_"), slug(home), slug(away), F.lit("01")).alias("match_id"), day.alias("date"), home.alias("home_team"), away.alias("away_team"),
        F.coalesce("goals.home", F.lit(0)).alias("score_home"), F.coalesce("goals.away", F.lit(0)).alias("score_away"),
        F.map_from_entries(F.concat(entries, absent)).alias("team_stats"), events.alias("events"))
