"""Readers of labels, annotations and spots into DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of folders that label what they hold, and file endings of images.
EMPTY_NAMES, OCCUPIED_NAMES = ("empty", "free", "vacant", "0"), ("occupied", "busy", "full", "1")
IMAGE_NAMES = r"(?i)\.(jpg|jpeg|png|bmp)$"
IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG,BMP}"
WEATHER = {"S": "SUNNY", "O": "OVERCAST", "R": "RAINY"}
BOX = "array<double>"
BOXES = "array<array<double>>"


def read_patch_folder(spark: SparkSession, root: str, group_level: int | None = None) -> DataFrame:
    """path, label, grp of all images under `root` whose nearest telling folder names a label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").where(F.col("path").rlike(IMAGE_NAMES))
    base = re.escape(root.rstrip("/").removeprefix("file:").lstrip("/") + "/")
    inside = F.element_at(F.split("path", base), -1)
    parts = F.split(inside, "/")
    folders = F.reverse(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower))
    telling = F.get(F.filter(folders, lambda x: x.isin(*EMPTY_NAMES, *OCCUPIED_NAMES)), F.lit(0))
    group = F.lit("root") if group_level is None else F.when(F.size(parts) > group_level + 1, F.get(parts, F.lit(group_level))).otherwise("root")
    df = files.select("path", telling.isin(*OCCUPIED_NAMES).cast("int").alias("label"), group.alias("grp")).where(F.col("label").isNotNull())
    if df.isEmpty():
        raise ValueError(f"no labelled image under {root}")
    return df


def read_label_list(spark: SparkSession, list_file: str, image_root: str, group_level: int | None = None) -> DataFrame:
    """path, label, grp of lines `<path> <label>`, cut at their last white space; blank lines are skipped."""
    lines = spark.read.text(list_file).select(F.trim("value").alias("line")).where("line <> ''")
    path, label = F.regexp_extract("line", r"^(.*\S)\s+(\S+)$", 1), F.regexp_extract("line", r"^(.*\S)\s+(\S+)$", 2)
    group = F.lit("root") if group_level is None else F.element_at(F.split(path, "/"), group_level + 1)
    return lines.select(F.concat(F.lit(image_root.rstrip("/") + "/"), path).alias("path"), label.cast("int").alias("label"), group.alias("grp"))


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """id, polygon (points x, y), owner, meta, width, height; the size null where it is unknown."""
    schema = f"image_size array<int>, spots array<struct<id:string,polygon:{BOXES},owner:string,meta:map<string,string>>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    one = doc.select(F.explode("spots").alias("s"), F.get("image_size", F.lit(0)).alias("width"), F.get("image_size", F.lit(1)).alias("height"))
    points = F.transform("s.polygon", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return one.select("s.id", points.alias("polygon"), "s.owner", "s.meta", "width", "height")


def write_spots(spots: DataFrame, path: str) -> None:
    """One JSON document of spots and image size; coordinates to a tenth, half to even."""
    points = F.transform("polygon", lambda p: F.array(F.bround(p["x"], 1), F.bround(p["y"], 1)))
    meta = F.when(F.size("meta") > 0, F.col("meta"))
    s = F.struct("id", points.alias("polygon"), F.when(F.col("owner") != "", F.col("owner")).alias("owner"), meta.alias("meta"))
    size = F.when(F.max("width").isNotNull(), F.array(F.max("width"), F.max("height")))
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    spots.agg(size.alias("image_size"), F.array_sort(F.collect_list(s), by_id).alias("spots")).coalesce(1).write.mode("overwrite").json(path)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """image, cars, negatives, random_negatives, ts, grp of an annotations document."""
    schema = f"frames array<struct<image:string,timestamp:string,cars:{BOXES},negatives:{BOXES},random_negatives:boolean,group:string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    f = doc.select("file", F.explode("frames").alias("f")).select("file", "f.*")
    folder = F.element_at(F.split("file", "/"), -2)
    ts = F.to_timestamp_ntz("timestamp")
    group = F.coalesce("group", F.when(ts.isNotNull(), F.concat_ws(":", folder, F.to_date(ts).cast("string"))).otherwise(folder))
    none = F.array().cast(BOXES)
    boxes = [F.coalesce(c, none).alias(c) for c in ("cars", "negatives")]
    return f.select("image", *boxes, F.coalesce("random_negatives", F.lit(True)).alias("random_negatives"), ts.alias("ts"), group.alias("grp"))


def voc_root(spark: SparkSession, root: str) -> str:
    """The folder that holds Annotations: `root` or one below it, on any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    level, found = [path], []
    for _ in range(6):  # levels of folders
        folders = [s.getPath() for p in level for s in fs.listStatus(p) if s.isDirectory()]
        if level == [path] and any(f.getName() == "Annotations" for f in folders):
            return root
        found += [f for f in level if any(x.getName() == "Annotations" and x.getParent().equals(f) for x in folders)]
        level = [f for f in folders if f.getName() not in ("Annotations", "JPEGImages", "ImageSets")]
        if not level:
            break
    if not found:
        raise ValueError(f"no Annotations under {root}")
    return min((f.getName() != "VOC2007", f.toString()) for f in found)[1]


def read_voc(spark: SparkSession, root: str, split: str = "trainval", cls: str = "car", n_background: int | None = None, seed: int = 0) -> DataFrame:
    """id, cars, ignore, with_cls: images of the split, those with the class first; mins are shifted by one, difficult objects ignored.

    If `root` has no Annotations, the first folder below it that has is taken, one named VOC2007 before others.
    """
    root = voc_root(spark, root)
    ids = spark.read.text(f"{root}/ImageSets/Main/{split}.txt").select(F.trim("value").alias("id")).where("id <> ''").withColumn("place", F.monotonically_increasing_id())
    box = "xmin double, ymin double, xmax double, ymax double"
    schema = f"object array<struct<name:string,difficult:string,bndbox:struct<{box.replace(' ', ':').replace(',:', ',')}>>>"
    xml = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(f"{root}/Annotations").withColumn("id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1))
    own = F.filter(F.coalesce("object", F.array().cast(schema.split(" ", 1)[1])), lambda o: o["name"] == cls)
    corners = lambda hard: F.transform(F.filter(own, lambda o: (F.coalesce(o["difficult"], F.lit("0")) == "1") == F.lit(hard)), lambda o: F.array(o["bndbox"]["xmin"] - 1, o["bndbox"]["ymin"] - 1, o["bndbox"]["xmax"], o["bndbox"]["ymax"]))
    df = ids.join(xml.select("id", corners(False).alias("cars"), corners(True).alias("ignore")), "id").withColumn("with_cls", F.size("cars") + F.size("ignore") > 0)
    if n_background is not None:
        drawn = df.where("NOT with_cls").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n_background)
        df = df.where("with_cls").unionByName(drawn)
    return df.orderBy(F.desc("with_cls"), "place").drop("place")


def read_cnr(spark: SparkSession, root: str, cameras: list[int] | None = None, full: tuple[int, int] = (2592, 1944), size: tuple[int, int] = (1000, 750)) -> DataFrame:
    """camera, ts, image, weather, cars, negatives, slots, grp of each frame whose image exists."""
    log = spark.read.option("header", "true").csv(f"{root}/CNRPark+EXT.csv").where(~F.col("camera").isin("A", "B")).withColumn("camera", F.col("camera").cast("int"))
    log = log.withColumn("row", F.monotonically_increasing_id())
    if cameras:
        log = log.where(F.col("camera").isin(*cameras))
    files = spark.read.option("header", "true").csv(f"{root}/camera[0-9]*.csv").withColumn("camera", F.regexp_extract(F.input_file_name(), r"camera(\d+)\.csv$", 1).cast("int"))
    sx, sy = size[0] / full[0], size[1] / full[1]
    x, y, w, h = (F.col(c).cast("double") for c in "XYWH")
    bays = files.select("camera", F.col("SlotId").cast("int").alias("slot"), F.array(x * sx, y * sy, (x + w) * sx, (y + h) * sy).alias("box"))
    ts = F.to_timestamp_ntz(F.col("datetime"), F.lit("yyyy-MM-dd_HH.mm"))
    named = log.select("camera", "datetime", ts.alias("ts"), "weather", F.col("slot_id").cast("int").alias("slot"), F.col("occupancy").cast("int").alias("occ"), "row")
    frames = named.groupBy("camera", "datetime", "ts").agg(F.min_by("weather", "row").alias("w"))
    sky = F.element_at(F.create_map(*[F.lit(x) for kv in WEATHER.items() for x in kv]), F.col("w"))
    image = F.concat_ws("/", F.lit(root.rstrip("/")), F.lit("FULL_IMAGE_1000x750"), sky, F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("camera"), "camera"), F.concat(F.date_format("ts", "yyyy-MM-dd_HHmm"), F.lit(".jpg")))
    frames = frames.select("camera", "datetime", "ts", sky.alias("weather"), image.alias("image"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("image"))
    frames = frames.join(there, "image", "left_semi")
    part = lambda v: F.collect_list(F.when(F.col("occ") == v, F.col("box")))
    own = named.join(bays, ["camera", "slot"]).groupBy("camera", "datetime").agg(part(1).alias("cars"), part(0).alias("negatives"), F.map_from_entries(F.collect_list(F.struct("slot", "occ"))).alias("slots"))
    out = frames.join(own, ["camera", "datetime"], "left")
    return out.select("camera", "ts", "image", "weather", "cars", "negatives", "slots", F.concat(F.lit("camera"), "camera", F.lit(":"), F.to_date("ts").cast("string")).alias("grp")).orderBy("camera", "ts")


TIMED, TIME = r"^\d{8}_\d{4}$", "yyyyMMdd_HHmm"


def with_times(frames: DataFrame, changed: Column | None = None) -> DataFrame:
    """`frames` (path) with ts: the time in the file's name, or else `changed`."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    named = F.when(stem.rlike(TIMED), F.to_timestamp_ntz(stem, F.lit(TIME)))
    return frames.withColumn("ts", named if changed is None else F.coalesce(named, changed))


def frame_times(spark: SparkSession, root: str) -> DataFrame:
    """path, ts of image files: the time in the name, or else when the file was changed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(IMAGE_NAMES))
    return with_times(files, F.col("modificationTime").cast("timestamp_ntz")).select("path", "ts").orderBy("ts", "path")


def sampled(frames: DataFrame, fps: float, every_seconds: float, number: str = "i") -> DataFrame:
    """Every `max(1, int(fps * seconds))`-th frame; 25 frames a second where it is unknown."""
    step = max(1, int((fps or 25) * every_seconds))
    return frames.where(F.pmod(F.col(number), F.lit(step)) == 0)


def decoded(img: DataFrame) -> DataFrame:
    """path, pixels (RGB), height, width of Spark's image column; an undecodable image is an error."""
    img = img.select("image.*")
    checked = F.when(F.col("mode") < 0, F.raise_error(F.concat(F.lit("can't decode "), F.col("origin")))).otherwise(F.col("data"))
    raw = img.select(F.col("origin").alias("path"), checked.alias("bgr"), "height", "width", "nChannels")

    def swap(batches):
        import numpy as np

        for pdf in batches:
            turned = []
            for data, h, w, n in zip(pdf.bgr, pdf.height, pdf.width, pdf.nChannels):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                turned.append((np.repeat(a, 3, 2) if n == 1 else a[..., 2::-1]).tobytes())
            yield pdf.assign(pixels=turned)[["path", "pixels", "height", "width"]]

    return raw.mapInPandas(swap, "path string, pixels binary, height int, width int")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, pixels (RGB), height, width of all images under `path`."""
    return decoded(spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(path))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """`read_images` with ts."""
    return read_images(spark, path).join(frame_times(spark, path).select(F.regexp_replace("path", "^file:/*", "file:///").alias("path"), "ts"), "path")


def scenes_of(frames: DataFrame, images: DataFrame, key: str = "image") -> DataFrame:
    """Annotated frames with their pixels: path, pixels, height, width, cars, negatives, ignore, random_negatives, grp; what is missing is empty, true, or the path."""
    none = F.array().cast(BOXES)
    have = lambda c, otherwise: F.coalesce(F.col(c), otherwise).alias(c) if c in frames.columns else otherwise.alias(c)
    own = frames.select(F.element_at(F.split(key, "/"), -1).alias("name"), *[have(c, none) for c in ("cars", "negatives", "ignore")], have("random_negatives", F.lit(True)), have("grp", F.element_at(F.split(key, "/"), -1)))
    return images.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(own, "name").drop("name")


def boxes_of(frames: DataFrame, column: str | Column, key: str = "image") -> DataFrame:
    """key, n, x1 to y2 of an array column of boxes."""
    c = F.col(column) if isinstance(column, str) else column
    e = frames.select(key, F.posexplode(c).alias("n", "b"))
    return e.select(key, "n", *[F.get("b", F.lit(k)).alias(x) for k, x in enumerate(("x1", "y1", "x2", "y2"))])
