"""Intake of checkouts as tables of files (checkout, relpath, content): manifests, environments, entry points."""

from __future__ import annotations

import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of names of variables that are kept from a run, and the pin where none is declared.
SECRET_PARTS = ("API_KEY", "AUTH", "PASSWORD", "PASSWD", "PRIVATE_KEY", "SECRET", "TOKEN")
DEFAULT_PIN = "3.11"
_ROOT_FILES = {"uv_lock": "uv.lock", "poetry_lock": "poetry.lock", "pyproject": "pyproject.toml", "environment_yml": "environment.yml", "makefile": "Makefile", "main_py": "main.py"}


def repo_kind(location: Column) -> Column:
    """git, archive or local, by the form of a location."""
    low = F.lower(location)
    return F.when(low.rlike(r"\.(tar\.gz|tgz|zip)\z"), "archive").when(low.rlike(r"^(https?|ssh|git|file)://|^git@|\.git\z"), "git").otherwise("local")


def scrubbed(env: Column) -> Column:
    """A map of variables without those whose names hold a secret's part."""
    return F.map_filter(env, lambda k, _: ~F.upper(k).rlike("|".join(SECRET_PARTS)))


def manifests(files: DataFrame) -> DataFrame:
    """Per checkout which manifests its root has, and its root's requirements files and notebooks, sorted."""
    root = files.where(~F.col("relpath").contains("/"))
    flags = [F.coalesce(F.bool_or(F.col("relpath") == name), F.lit(False)).alias(k) for k, name in _ROOT_FILES.items()]
    named = lambda pattern: F.array_sort(F.collect_set(F.when(F.col("relpath").rlike(pattern), F.col("relpath"))))
    found = root.groupBy("checkout").agg(*flags, named(r"^requirements.*\.txt\z").alias("requirements"), named(r"\.ipynb\z").alias("notebooks"))
    return files.select("checkout").distinct().join(found, "checkout", "left").na.fill(False)


def environments(files: DataFrame) -> DataFrame:
    """checkout, python_pin, pin_source, policy: .python-version, requires-python, the default; lockfile, poetry, declared, best-effort."""
    text = F.decode("content", "UTF-8")
    own = F.max(F.when(F.col("relpath") == ".python-version", F.nullif(F.trim(F.regexp_replace(text, r"\s+$", "")), F.lit(""))))
    asked = F.max(F.when(F.col("relpath") == "pyproject.toml", F.nullif(F.regexp_extract(text, r"requires-python\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))))
    pins = files.groupBy("checkout").agg(own.alias("_own"), asked.alias("_asked"))
    policy = F.when(F.col("uv_lock"), "lockfile").when(F.col("poetry_lock"), "poetry").when(F.size("requirements") > 0, "declared").otherwise("best-effort")
    source = F.when(F.col("_own").isNotNull(), ".python-version").when(F.col("_asked").isNotNull(), "pyproject.toml").otherwise("default")
    d = pins.join(manifests(files), "checkout")
    return d.select("checkout", F.coalesce("_own", "_asked", F.lit(DEFAULT_PIN)).alias("python_pin"), source.alias("pin_source"), policy.alias("policy"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _scripts(data: pa.Array) -> pa.Array:
    """Sorted script names of a pyproject file; null if it can't be read."""

    def read(x):
        try:
            found = tomllib.loads(x.decode("utf-8")).get("project", {}).get("scripts", {})
            return sorted(found) if isinstance(found, dict) else []
        except (UnicodeDecodeError, tomllib.TOMLDecodeError, AttributeError):
            return None

    return pa.array([None if x is None else read(x) for x in data.to_pylist()], pa.list_(pa.string()))


def entry_points(files: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """checkout, argv, source, cause: an explicit command (checkout, argv), else the only script or main.py, else the only
    root notebook; none or an unreadable pyproject is ENTRYPOINT_MISSING, several ENTRYPOINT_AMBIGUOUS."""
    listed = files.where("relpath = 'pyproject.toml'").select("checkout", _scripts("content").alias("scripts"), F.lit(True).alias("has"))
    d = manifests(files).join(listed, "checkout", "left")
    given = explicit if explicit is not None else files.sparkSession.createDataFrame([], "checkout string, argv array<string>")
    d = d.join(given.withColumnRenamed("argv", "given"), "checkout", "left")
    item = lambda source, argv: F.struct(F.lit(source).alias("source"), argv.alias("argv"))
    none = F.array().cast("array<struct<source:string,argv:array<string>>>")
    scripts = F.coalesce(F.transform("scripts", lambda s: item("pyproject-script", F.array(F.lit("uv"), F.lit("run"), s))), none)
    main = F.when(F.col("main_py"), F.array(item("main.py", F.array(F.lit("python"), F.lit("main.py"))))).otherwise(none)
    command = [F.lit(x) for x in ("jupyter", "nbconvert", "--to", "notebook", "--execute", "--inplace")]
    notebooks = F.coalesce(F.transform("notebooks", lambda n: item("notebook", F.array(*command, n))), none)
    d = d.withColumn("_first", F.concat(scripts, main))
    d = d.withColumn("_all", F.when(F.size("_first") > 0, F.col("_first")).otherwise(notebooks))
    unread = F.coalesce(F.col("has"), F.lit(False)) & F.col("scripts").isNull()
    cause = (
        F.when(F.col("given").isNotNull(), F.when(F.size("given") == 0, "ENTRYPOINT_MISSING"))
        .when(unread | (F.size("_all") == 0), "ENTRYPOINT_MISSING")
        .when(F.size("_all") > 1, "ENTRYPOINT_AMBIGUOUS")
    )
    one = F.get("_all", F.lit(0))
    return d.select(
        "checkout",
        F.when(cause.isNull(), F.coalesce(F.col("given"), one["argv"])).alias("argv"),
        F.when(cause.isNull(), F.when(F.col("given").isNotNull(), "explicit").otherwise(one["source"])).alias("source"),
        cause.alias("cause"),
    )
