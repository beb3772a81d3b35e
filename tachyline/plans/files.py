"""Table directories through Hadoop's file API, so any cluster store works."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the session's shared checkpoint folder.

    Without that setting a local session gets a temporary folder; a cluster session
    is refused, since a machine-local folder is not shared by its executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tachyline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tachyline/{label}-{uuid.uuid4().hex[:12]}"


#: Directories that are renamed or deleted at once.
AT_ONCE = 16


def side_by_side(work: Callable[[object], object], items: Iterable) -> list:
    """``work`` of each item, several at once: directory operations wait for the file system. Raises what one raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


class Files:
    """Directory operations on whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._new_array = spark.sparkContext._gateway.new_array
        self._conf = spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._open(path)
        return fs.exists(target)

    def make(self, path: str) -> None:
        fs, target = self._open(path)
        fs.mkdirs(target)

    def children(self, path: str) -> list[str]:
        fs, target = self._open(path)
        if not fs.exists(target):
            return []
        return sorted(status.getPath().getName() for status in fs.listStatus(target))

    def delete(self, path: str) -> None:
        fs, target = self._open(path)
        fs.delete(target, True)

    def delete_empty(self, path: str) -> None:
        if self.exists(path) and not self.children(path):
            self.delete(path)

    def rename(self, source: str, target: str) -> None:
        fs, old = self._open(source)
        _, new = self._open(target)
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            raise OSError(f"could not rename {source} to {target}")

    def read_text(self, path: str) -> str | None:
        """A small text file read by the driver, without a job; None if there is none."""
        fs, target = self._open(path)
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        fs, target = self._open(path)
        stream = fs.create(target, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def below(self, path: str, *levels: str) -> list[str]:
        """Partition directories below ``path`` by one pattern a level, relative to it: a few calls, however many there are."""
        fs, target = self._open(re.sub(r"([][\\*?{}^])", r"\\\1", path))
        found = fs.globStatus(self._jvm.org.apache.hadoop.fs.Path(target, "/".join(levels)))
        if not found:
            return []
        paths, objects = self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found), self._new_array(self._jvm.java.lang.Object, len(found))
        self._jvm.java.lang.System.arraycopy(paths, 0, objects, 0, len(found))
        text = self._jvm.java.util.Arrays.toString(objects)
        name = r"\w+=[^/,\]]+"
        return sorted(re.findall("/".join([name] * len(levels)) + r"(?=, |\]$)", text))

    def leaves(self, path: str, depth: int) -> list[str]:
        """Partition directories ``depth`` levels down, relative to ``path``."""
        found = [""]
        for _ in range(depth):
            found = [
                f"{above}/{name}" if above else name
                for above in found
                for name in self.children(f"{path}/{above}" if above else path)
                if "=" in name
            ]
        return found

    def finish_swap(self, live: str, parked: str) -> None:
        """Finish or undo a directory swap that a crash interrupted."""
        if self.exists(parked):
            if self.exists(live):
                self.delete(parked)
            else:
                self.rename(parked, live)

    def chunks(self, table: str, date: str = "event_date", hour: str = "event_hour") -> list[dt.datetime]:
        """Start of each time chunk for which a table has a directory, its own or a shared one."""
        held = (name.split("/") for name in self.below(table, f"{date}=*", f"{hour}=*"))
        return sorted({start for day, code in held for start in chunks_of(day_of(day), int(code.split("=")[1]))})


def day_of(name: str) -> dt.datetime:
    return dt.datetime.fromisoformat(name.split("=", 1)[1])


def hours_code(hours: Iterable[int]) -> int:
    """The hour of a directory name: of one chunk, or a negative number whose bits are the hours of several."""
    hours = set(hours)
    return min(hours) if len(hours) == 1 else -sum(1 << hour for hour in hours)


def chunks_of(day: dt.datetime, code: int) -> list[dt.datetime]:
    """Starts of the chunks that a directory of this day and hours' code holds."""
    hours = [code] if code >= 0 else [hour for hour in range(24) if -code >> hour & 1]
    return [day + dt.timedelta(hours=hour) for hour in hours]


def chunk_dir(
    table: str, start: dt.datetime, date: str = "event_date", hour: str = "event_hour"
) -> str:
    return f"{table}/{date}={start:%Y-%m-%d}/{hour}={start.hour}"
