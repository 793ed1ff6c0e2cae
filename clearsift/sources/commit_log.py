"""Numbered commits in a shared folder: a number is taken once, whoever else writes at the same time."""

from __future__ import annotations

import json
import re
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NUMBER = re.compile(r"\d{20}\.json")


class CommitLog:
    """A log of JSON entries, numbered from 1 without gaps, in a folder of any file system that Spark writes to.

    An entry is written under a name of its own and then gets its number, which fails if the number is taken: by a hard link on
    local and mounted folders, by a rename that does not overwrite elsewhere. So readers see whole entries only, and of writers that
    want one number one wins; the others see its entry and try the next number.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)
        self._turn = threading.Lock()
        self._known = 0  # a number that is known to be taken; later ones are looked for from here

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        if not self._files.exists(self._path("")):
            return []
        names = (f.getPath().getName() for f in self._files.listStatus(self._path("")))
        return sorted(int(n[:20]) for n in names if _NUMBER.fullmatch(n))

    def entry(self, number: int) -> dict:
        stream = self._files.open(self._path(f"{number:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _taken(self, number: int) -> bool:
        return self._files.exists(self._path(f"{number:020d}.json"))

    def last(self) -> int:
        """The last number, 0 if there is none: numbers have no gaps, so it is looked for in steps that double, then by halves."""
        low, step = self._known, 1
        while self._taken(low + step):
            low, step = low + step, step * 2
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._taken(middle) else (low, middle)
        self._known = max(self._known, low)
        return low

    def latest(self) -> tuple[int, dict] | None:
        number = self.last()
        return (number, self.entry(number)) if number else None

    def put(self, number: int, entry: dict) -> bool:
        """Writes an entry under a number; whether this writer got it."""
        if not self._known:
            self._files.mkdirs(self._path(""))
        ready, target = self._path(f".{uuid.uuid4().hex}"), self._path(f"{number:020d}.json")
        stream = self._files.create(ready, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            self._take(ready, target)
            return True
        except Py4JJavaError as refused:
            if "FileAlreadyExists" not in refused.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._files.delete(ready, False)

    def _take(self, ready, target) -> None:
        if self._files.getScheme() == "file":
            plain = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(plain(target), plain(ready))
            return
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        context.rename(self._files.makeQualified(ready), self._files.makeQualified(target), how)

    def append(self, make) -> tuple[int, dict]:
        """Puts make(latest entry or None) under the next number, again for each number that another writer got first.

        Writers that share this object take turns, as of those that want one number all but one would write in vain.
        """
        while True:
            with self._turn:
                last = self.latest()
                number, entry = (last[0] if last else 0) + 1, make(last[1] if last else None)
                if self.put(number, entry):
                    return number, entry
