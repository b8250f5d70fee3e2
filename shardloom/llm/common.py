"""What the operators of this subpackage share."""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import ship

#: A word is a run of anything but ASCII white space; both Java and DuckDB read this pattern alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer_file(name: str) -> str:
    """The path of a public vocabulary file, the same on every machine that has the package."""
    return public_tokenizers.path(name)


def send(module: str) -> None:
    """Send the functions of a module of this subpackage, and these helpers, with the tasks that use them."""
    ship(module)
    ship(__name__)


def once(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gave in this worker process before, else now: tables and caches outlive a task."""
    kept = sys.modules.setdefault("_shardloom_kept", types.ModuleType("_shardloom_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def byte_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
