"""Files on any file system that Spark's Hadoop configuration knows, from the driver; for small files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from .documents import _object


def joined(root: str, *parts: str) -> str:
    return "/".join((root.rstrip("/"), *parts))


class Storage:
    """Reads, lists and writes small files; a write is there whole or not at all.

    `write_new` lets one of several writers win: on local disks by a hard link,
    elsewhere by a rename that does not overwrite, as HDFS has it. Object stores
    whose rename is a copy need one writer at a time.
    """

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self._conf)
        if fs.getUri().getScheme() == "file":
            # without side files of checksums, which links would leave behind
            uri, fs = fs.getUri(), self._jvm.org.apache.hadoop.fs.RawLocalFileSystem()
            fs.initialize(uri, self._conf)
        return fs, fs.makeQualified(at)

    def _rename(self, temporary: str, target: str, overwrite: bool) -> bool:
        fs, source = self._at(temporary)
        _, to = self._at(target)
        if fs.getUri().getScheme() == "file":
            files, local = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            if overwrite:
                return fs.rename(source, to)
            try:
                files.createLink(local(to), local(source))
            except Exception as e:
                if "FileAlreadyExistsException" not in str(e):
                    raise
                return False
            finally:
                fs.delete(source, False)
            return True
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE if overwrite else option.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf)
        try:
            context.rename(source, to, options)
        except Exception as e:
            fs.delete(source, False)
            if overwrite or "FileAlreadyExistsException" not in str(e):
                raise
            return False
        return True

    def _staged(self, path: str, text: str) -> str:
        parent, _, name = path.rstrip("/").rpartition("/")
        temporary = f"{parent}/.{name}.{uuid.uuid4().hex}"
        fs, at = self._at(temporary)
        out = fs.create(at, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
            out.hsync()
        finally:
            out.close()
        return temporary

    def write_new(self, path: str, text: str) -> bool:
        """Write a file that is not there; False if it is."""
        return not self.exists(path) and self._rename(self._staged(path, text), path, False)

    def replace(self, path: str, text: str) -> None:
        self._rename(self._staged(path, text), path, True)

    def replace_object(self, path: str, value: dict) -> None:
        self.replace(path, json.dumps(value, ensure_ascii=False, allow_nan=False, indent=1, sort_keys=True) + "\n")

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def read(self, path: str) -> bytes:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_object(self, path: str) -> dict:
        try:
            return _object(json.loads(self.read(path)), path)
        except json.JSONDecodeError as e:
            raise ValueError(f"{path}:{e.lineno}:{e.colno}: {e.msg}") from None

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def modified(self, path: str) -> float:
        """Seconds since the epoch."""
        fs, at = self._at(path)
        return fs.getFileStatus(at).getModificationTime() / 1000

    def remove(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.delete(at, True)
