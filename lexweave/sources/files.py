"""Small files of settings and lists, through Hadoop's file systems: read with a default, written whole or not at all."""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def system(spark: SparkSession, path: str):
    """The file system that holds a path."""
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs = system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(_path(spark, folder))) if fs.exists(_path(spark, folder)) else []


def load_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    """The JSON value in a file; the default where the file is missing or holds no JSON."""
    if not system(spark, path).exists(_path(spark, path)):
        return default
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (json.JSONDecodeError, TypeError):
        return default


def write_json(spark: SparkSession, path: str, value: Any, replace: bool = True) -> bool:
    """Write a value beside its place and move it there in one step, so that a reader finds the old file, or the new one whole.

    Without replace nothing is written over, and of several writers one gets True.
    """
    data = json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1).encode()
    fs, target = system(spark, path), _path(spark, path)
    draft = target.getParent().suffix(f"/.{target.getName()}.{uuid.uuid4().hex}")
    try:
        out = fs.create(draft, False)
        try:
            out.write(data)
        finally:
            out.close()
        if not replace and fs.getUri().getScheme() == "file":
            # a local folder's own move looks first and moves then; a link is one step
            os.link(urllib.parse.urlparse(draft.toString()).path, urllib.parse.urlparse(target.toString()).path)
            return True
        rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
        one = spark.sparkContext._gateway.new_array(rename, 1)
        one[0] = rename.OVERWRITE if replace else rename.NONE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, one)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if not replace and fs.exists(target):
            return False
        raise e
    finally:
        fs.delete(draft, False)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds."""
    system(spark, path).delete(_path(spark, path), True)
