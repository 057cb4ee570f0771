"""The commands: which files are read, what is done, and how results are named after their input."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import image_hashes
from ..functions.quality import Rules, big_enough, signed, well_shaped
from ..operators.dedup import keep_first, missing_hash
from ..operators.scanner import cleaned, scan, write_side_files
from ..operators.setops import dedup_near, merge, remain
from ..schema import DHASH, MD5, PHASH, SPECS, HashSpec
from ..session import checkpointed, scope
from ..sources.images import local_path, read_files, read_images
from ..sources.text import hash_lines, pair_lines, read_hashes, read_paths, read_scan_list, write_lines


def _listed(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files with what was read of them; a listed file that does not exist has nulls."""
    return paths.join(files.withColumn("path", local_path()), "path", "left")


def _sized(paths: DataFrame, files: DataFrame, rules: Rules) -> DataFrame:
    return _listed(paths, files).filter(big_enough(F.col("length"), rules) & signed(F.col("path"), F.col("content"))).select("idx", "path")


def filter_files(paths: DataFrame, files: DataFrame, images: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``idx, path`` of the files that meet every rule; a missing or undecodable file is dropped.

    files: ``path, length, content``; images: ``path, height, width, nChannels``. Spark's image source decodes what lies under
    a folder before it can be joined with the list, so the decoded side is the whole folder's, looked at once.
    """
    shapes = images.filter("height > 0").select(local_path().alias("path"), "height", "width", "nChannels")
    return _sized(paths, files, rules).join(shapes, "path").filter(_shaped(rules)).select("idx", "path")


def _shaped(rules: Rules) -> Column:
    """Decoders in colour give three channels whatever the file has, so only strict rules look at the file's own number."""
    return well_shaped(F.col("width"), F.col("height"), rules, F.col("nChannels") if rules.strict_channels else None)


def _value(rows: DataFrame) -> DataFrame:
    return rows.select("idx", F.col("path").alias("value"))


def _hash_files(spark: SparkSession, root: str, paths: DataFrame, spec: HashSpec) -> DataFrame:
    if spec is MD5:
        rows = _listed(paths, read_files(spark, root)).select("idx", "path", F.unhex(F.md5("content")).alias("md5"))
    else:
        hashes = image_hashes(read_images(spark, root)).select("path", F.col(f"v_{spec.name}").alias(spec.name))
        rows = _listed(paths, hashes).select("idx", "path", spec.name)
    missing = rows.filter(F.col(spec.name).isNull()).head(1)
    if missing:
        raise ValueError(f"no {spec.name} of {missing[0]['path']}")
    return rows


def _loaded(spark: SparkSession, path: str, spec: HashSpec) -> DataFrame:
    rows, bad = read_hashes(spark, path, spec)
    if bad.head(1):
        write_lines(bad.select("idx", F.concat_ws("\t", "value", "reason").alias("value")), f"{path}.rejected")
    return rows


def cmd_filter(spark: SparkSession, root: str, name: str) -> str:
    write_lines(_value(filter_files(read_paths(spark, name), read_files(spark, root), read_images(spark, root))), f"{name}.filt")
    return f"{name}.filt"


def cmd_gen(spark: SparkSession, root: str, name: str, spec: HashSpec) -> str:
    write_lines(hash_lines(_hash_files(spark, root, read_paths(spark, name), spec), spec), f"{name}.{spec.name}")
    return f"{name}.{spec.name}"


def cmd_dedup_md5(spark: SparkSession, name: str) -> str:
    write_lines(_value(keep_first(_loaded(spark, name, MD5), "md5")), f"{name}.dedup")
    return f"{name}.dedup"


def cmd_dedup(spark: SparkSession, name: str, spec: HashSpec) -> str:
    rows = checkpointed(_loaded(spark, name, spec))
    kept, pairs = dedup_near(rows, spec)
    kept = checkpointed(kept)
    write_lines(pair_lines(pairs, rows), f"{name}.pair", ("i", "j"))
    write_lines(hash_lines(kept, spec), f"{name}.dedup.{spec.name}")
    write_lines(_value(kept), f"{name}.dedup")
    return f"{name}.dedup"


def cmd_merge(spark: SparkSession, names: list[str], target: str, spec: HashSpec) -> str:
    merged = merge([_loaded(spark, n, spec) for n in names], spec)
    write_lines(merged.select("part", "idx", F.col("path").alias("value")), target, ("part", "idx"))
    return target


def cmd_remain(spark: SparkSession, src: str, gallery: str, spec: HashSpec) -> str:
    write_lines(_value(remain(_loaded(spark, src, spec), _loaded(spark, gallery, spec), spec)), f"{src}.rem")
    return f"{src}.rem"


def cmd_scan(spark: SparkSession, name: str, target: str, batch: int = 2000) -> str:
    paths = read_scan_list(spark, name)
    verdicts = checkpointed(scan(paths, batch))
    write_side_files(verdicts, target.rpartition("/")[0] or ".")
    write_lines(_value(cleaned(paths, verdicts)), target)
    return target


def cmd_pipeline(spark: SparkSession, root: str, name: str, rules: Rules = Rules()) -> str:
    """filter, MD5, phash and dhash in turn; every stage leaves its file, named by the chain of suffixes.

    All hashes of the kept files are computed in one pass over the pixels and used by later stages. Files of sufficient
    size and the right signatures that cannot be decoded go to ``.filt.rejected``, files that then have no hash to
    ``.rejected`` behind the names of the stages before.
    """
    images = read_images(spark, root)
    looked = checkpointed(images.select("path", "height", "width", "nChannels").join(image_hashes(images), "path"))
    sized = _sized(read_paths(spark, name), read_files(spark, root), rules)
    shapes = checkpointed(_listed(sized, looked))
    decoded = F.coalesce(F.col("height") > 0, F.lit(False))
    kept = checkpointed(shapes.filter(decoded & _shaped(rules)).select("idx", "path"))
    at = f"{name}.filt"
    write_lines(_value(kept), at)
    write_lines(_value(shapes.filter(~decoded)), f"{at}.rejected")
    digests = checkpointed(_hash_files(spark, root, kept, MD5))
    write_lines(hash_lines(digests, MD5), f"{at}.md5")
    rows = checkpointed(keep_first(digests, "md5"))
    at = f"{at}.md5.dedup"
    write_lines(_value(rows), at)
    rows = checkpointed(rows.select("idx", "path").join(shapes.select("idx", F.col("v_dhash").alias("dhash"), F.col("v_phash").alias("phash")), "idx"))
    write_lines(_value(missing_hash(rows, DHASH)), f"{at}.rejected")
    rows = rows.filter("dhash IS NOT NULL")
    for spec in (PHASH, DHASH):
        write_lines(hash_lines(rows, spec), f"{at}.{spec.name}")
        left, pairs = dedup_near(rows, spec)
        left = checkpointed(left)
        write_lines(pair_lines(pairs, rows), f"{at}.{spec.name}.pair", ("i", "j"))
        at = f"{at}.{spec.name}.dedup"
        write_lines(_value(left), at)
        write_lines(hash_lines(left, spec), f"{at}.{spec.name}")
        rows = left
    return at


class Watch:
    """A named stop-watch that tells hours, minutes and seconds."""

    def __init__(self, name: str):
        self.name, self.start = name, time.monotonic()

    def __str__(self) -> str:
        s = int(time.monotonic() - self.start)
        return f"{self.name}: {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


COMMANDS: dict[str, Callable] = {
    "filter": cmd_filter,
    "dedup_md5": lambda spark, root, name: cmd_dedup_md5(spark, name),
    "pipeline": cmd_pipeline,
    "scan": lambda spark, root, name, target: cmd_scan(spark, name, target),
}
for _spec in SPECS.values():
    COMMANDS[f"gen_{_spec.name}"] = lambda spark, root, name, spec=_spec: cmd_gen(spark, root, name, spec)
for _spec in (DHASH, PHASH):
    COMMANDS[f"dedup_{_spec.name}"] = lambda spark, root, name, spec=_spec: cmd_dedup(spark, name, spec)
    COMMANDS[f"merge_{_spec.name}"] = lambda spark, root, *names, spec=_spec: cmd_merge(spark, list(names[:-1]), names[-1], spec)
    COMMANDS[f"remain_{_spec.name}"] = lambda spark, root, src, gallery, spec=_spec: cmd_remain(spark, src, gallery, spec)


def run(spark: SparkSession, command: str, root: str, *args: str) -> str:
    """root is the folder under which listed files lie (for commands that read files)."""
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command!r}; there are {', '.join(sorted(COMMANDS))}")
    watch = Watch(command)
    with scope():
        out = COMMANDS[command](spark, root, *args)
    print(watch)
    return out
