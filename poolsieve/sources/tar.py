"""Tar shards: samples are runs of files with one name but for the ending."""

from __future__ import annotations

import json
import tarfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


def group_members(members: Iterable[tuple[str, bytes | None]]) -> Iterator[tuple[str, dict[str, bytes | None]]]:
    """Samples of consecutive files.  A new one begins with another prefix, or with an ending that it has already.

    The ending is all from the first dot of the file's name on, in lower case;
    names without one are passed over.
    """
    key, fields = None, {}
    for name, data in members:
        folder, _, base = name.rpartition("/")
        stem, dot, ending = base.partition(".")
        if not dot or not stem:
            continue
        prefix = f"{folder}/{stem}" if folder else stem
        ending = ending.lower()
        if prefix != key or ending in fields:
            if fields:
                yield key, fields
            key, fields = prefix, {}
        fields[ending] = data
    if fields:
        yield key, fields


def tar_members(stream, wanted: Callable[[str], bool] = lambda _: True) -> Iterator[tuple[str, bytes | None]]:
    """Regular files of a tar in their order; of those that are not wanted, the content is passed over and None.

    Raises ``tarfile.TarError`` where the tar is damaged.
    """
    with tarfile.open(fileobj=stream) as tar:
        for member in tar:
            if member.isfile():
                if not wanted(member.name):
                    yield member.name, None
                    continue
                data = tar.extractfile(member).read()
                if len(data) != member.size:
                    raise tarfile.ReadError("a member is cut short")
                yield member.name, data
        if tar.fileobj is stream:  # not compressed: zeros mark the end
            stream.seek(max(0, stream.seek(0, 2) - 512))
            if any(stream.read(512)):
                raise tarfile.ReadError("there is no end mark")


def sample_uid(fields: dict[str, bytes]) -> str | None:
    """The id that a sample's JSON file tells; None if there is none to be read."""
    try:
        uid = json.loads(fields["json"]).get("uid")
    except (KeyError, ValueError, TypeError, AttributeError):
        return None
    return uid if isinstance(uid, str) else None


#: What ``read_index`` tells of a sample.
INDEX = "shard_name string, place long, key string, uid string, damaged string"


def read_index(spark: SparkSession, folder: str, pattern: str = "*.tar", first_shard: int = 0, num_shards: int | None = None, split: int | None = None, name_format: str | None = None) -> DataFrame:
    """``shard_name, place, key, uid, damaged`` of the samples of all tars; only headers and JSON members are read.

    With ``name_format``, as ``part-{:05d}.tar``, only of tars with such names.

    A damaged tar gives the samples before the damage, and a row without a key
    that says what is wrong.
    """
    from poolsieve.sources.formats import register

    given = {"num_shards": num_shards, "split": split, "name_format": name_format}
    options = {"pattern": pattern, "first_shard": first_shard} | {k: v for k, v in given.items() if v is not None}
    return register(spark).read.format("pool_tar").schema(INDEX).options(**options).load(folder)


def read_samples(spark: SparkSession, folder: str, pattern: str = "*.tar", split: int | None = None) -> DataFrame:
    """``shard_name, key, uid, fields``; uid is that of the sample's JSON file, null if there is none to be read.

    ``damaged_tars`` of the index tells which tars end early.
    """
    from poolsieve.sources.formats import register

    options = {"pattern": pattern} | ({} if split is None else {"split": split})
    return register(spark).read.format("pool_tar").schema("shard_name string, key string, uid string, fields map<string,binary>").options(**options).load(folder)


def damaged_tars(index: DataFrame) -> DataFrame:
    """``shard_name, damaged``: what is wrong with tars that cannot be read to their end."""
    return index.where("damaged IS NOT NULL").select("shard_name", "damaged")
