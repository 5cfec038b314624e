"""Finding datasets under roots, and telling paths apart."""

from __future__ import annotations

import os
import posixpath
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodelake.operators.sets import first_of
from episodelake.operators.windows import places
from episodelake.paths import exists

#: The file that marks a dataset and the file that lists datasets.
MARKER, LISTING = "meta/info.json", "dataloader.json"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)"
#: Requests to the file system at a time.
REQUESTS = 32


def plain_path(path: Column, base: Column | None = None) -> Column:
    """A path without '.', '..', empty steps and a final slash; a relative one is taken from ``base``; a file scheme is left out.

    Only the text counts: links are followed by ``real_path``.
    """
    if base is not None:
        path = F.when(path.rlike(SCHEME) | path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    head, rest = F.regexp_extract(path, SCHEME, 1), F.regexp_replace(path, SCHEME, "")
    rooted = rest.startswith("/") | (head != "")
    steps = F.filter(F.split(rest, "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, s: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(s)))
        return F.when(F.size(done) == 0, F.when(s != "..", F.array(s)).when(rooted, done).otherwise(F.array(s))).otherwise(F.when(s == "..", up).otherwise(F.concat(done, F.array(s))))

    folded = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    out = F.concat(F.when(head.rlike("^file:"), "").otherwise(head), F.when(rooted, "/").otherwise(""), folded)
    return F.when(out == "", ".").otherwise(out)


@F.udf(T.StringType(), useArrow=True)
def _followed(path: str) -> str:
    return os.path.realpath(path) if path is not None and path.startswith("/") else path


def real_path(path: Column, base: Column | None = None) -> Column:
    """The plain path, with links followed where it is on a local or mounted file system."""
    return _followed(plain_path(path, base))


def first_paths(df: DataFrame, path: str, order: str, follow: bool = False) -> DataFrame:
    """The first row by ``order`` of all whose paths lead to the same place."""
    key = real_path(F.col(path)) if follow else plain_path(F.col(path))
    return first_of(df.withColumn("__key", key), "__key", order).drop("__key")


def _join(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _listed(root: str, path: str) -> str:
    """A path of a list: as it stands if absolute, else from the root with links followed."""
    if path.startswith("/") or re.match(SCHEME, path):
        return path.rstrip("/") or "/"
    scheme = re.match(SCHEME, root)
    head, rest = (scheme[1], root[scheme.end() :]) if scheme else ("", root)
    joined = posixpath.join(rest, path)
    return os.path.realpath(joined) if head in ("", "file:", "file://") else head + posixpath.normpath(joined)


def discover(spark: SparkSession, roots: str | list[str], marker: str = MARKER, listing: str = LISTING) -> DataFrame:
    """(place, root, dataset) of the datasets that the roots stand for, in order, each place on disk once.

    A root is a dataset itself if it has the marker file; else the datasets that
    its list names, of which those without a marker are skipped; else, also if
    none of the list is there, its child directories with a marker. Datasets
    are in the order of the roots, and of their paths inside a root; of paths
    that lead to the same place the first stays. A root that is not there has
    none; no dataset at all is an error.

    The driver asks for a marker and a list once for each root and for a marker
    for each listed path, and reads each list once; children are listed by
    Spark's file source, in tasks where there are many.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    with ThreadPoolExecutor(REQUESTS) as pool:
        there = lambda paths: list(pool.map(lambda p: exists(spark, p), paths))
        own, lists = there([_join(r, marker) for r in roots]), there([_join(r, listing) for r in roots])
        found = [(i, r, r.rstrip("/")) for i, (r, is_own) in enumerate(zip(roots, own, strict=True)) if is_own]
        asked = []
        for i in (i for i in range(len(roots)) if lists[i] and not own[i]):
            text = spark.read.text(_join(roots[i], listing), wholetext=True)
            paths = text.select(F.explode(F.from_json("value", "dataset_paths array<string>")["dataset_paths"]).alias("p")).where("trim(p) <> ''")
            asked += [(i, roots[i], _listed(roots[i], r["p"])) for r in paths.collect()]  # a list names some thousands at most
        found += [x for x, ok in zip(asked, there([_join(p, marker) for _, _, p in asked]), strict=True) if ok]
        done = {i for i, _, _ in found}
        globs = [(i, r, _join(r, f"*/{marker}")) for i, r in enumerate(roots) if i not in done]
        matched = list(pool.map(lambda g: bool(_matches(spark, g[2])), globs))
    parts = spark.createDataFrame(found, "i long, root string, dataset string")
    for (i, root, glob), some in zip(globs, matched, strict=True):
        if some:
            files = spark.read.format("binaryFile").load(glob).select("path")
            child = F.regexp_replace(F.regexp_replace("path", "/" + re.escape(marker) + "$", ""), "^file:(//)?/", "/")
            parts = parts.unionByName(files.select(F.lit(i).cast("long").alias("i"), F.lit(root).alias("root"), child.alias("dataset")))
    ordered = places(parts.distinct(), ["i", "dataset"])
    if ordered.isEmpty():
        raise ValueError(f"no dataset under {roots}")
    kept = first_paths(ordered, "dataset", "place", follow=True)
    return places(kept.drop("place"), ["i", "dataset"]).select("place", "root", "dataset")


def _matches(spark: SparkSession, glob: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])
