"""One file per row, written by tasks and committed in two phases.

A sink of the Python Data Source API stages the rows: every task attempt writes its files below a folder of its
own and reports that folder; a failed write removes what its tasks reported, and nothing is visible yet.  A Spark job
then moves the files of the reported folders to their places, one task per folder, so neither the files nor
their names pass through the driver.  Moves can be repeated: a task that is lost and run again goes on
where it stopped.  ``_SUCCESS`` is written last.

Paths are URIs of any file system that pyarrow knows, or local folders that all executors share.
"""

import posixpath
import sys
import time
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

# Workers get what they run with the task and need no module.
register_pickle_by_value(sys.modules[__name__])

STAGED = "pressmill_staged_files"


def _staging_source():
    """The sink.  It is defined here so that workers get it with the task and need no module."""
    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    class Attempt(WriterCommitMessage):
        def __init__(self, folder):
            self.folder = folder

    class StagingWriter(DataSourceWriter):
        def __init__(self, path):
            self.path = path

        def _place(self):
            from pyarrow import fs

            if "://" in self.path or self.path.startswith("file:"):
                return fs.FileSystem.from_uri(self.path)
            return fs.LocalFileSystem(), self.path

        def write(self, rows):
            import uuid

            system, root = self._place()
            folder, made = f"attempt-{uuid.uuid4().hex}", set()
            for folder_name, file_name, text in rows:
                parent = f"{root}/{folder}/{folder_name or ''}".rstrip("/")
                if parent not in made:
                    system.create_dir(parent)
                    made.add(parent)
                with system.open_output_stream(f"{parent}/{file_name}") as out:
                    out.write((text or "").encode("utf-8"))
            return Attempt(folder if made else None)

        def commit(self, messages):
            system, root = self._place()
            system.create_dir(root)
            with system.open_output_stream(f"{root}/attempts.txt") as out:   # one line per task
                out.write("".join(f"{m.folder}\n" for m in messages if m and m.folder).encode())

        def abort(self, messages):
            system, root = self._place()
            if system.get_file_info(root).is_file or system.get_file_info(root).type.name == "Directory":
                system.delete_dir(root)

    class StagedFiles(DataSource):
        @classmethod
        def name(cls):
            return "pressmill_staged_files"

        def schema(self):
            return "folder string, file_name string, text string"

        def writer(self, schema, overwrite):
            return StagingWriter(self.options["path"])

    return StagedFiles


def _moved(staging, path):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        def place(uri):
            return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)

        system, source = place(staging)
        target = place(path)[1]
        for batch in batches:
            moved = []
            for attempt in batch.column(0).to_pylist():
                top, n, made = f"{source}/{attempt}", 0, set()
                for info in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
                    if info.type != fs.FileType.File:
                        continue
                    goal = f"{target}/{info.path[len(top) + 1:]}"
                    parent = goal.rsplit("/", 1)[0]
                    if parent not in made:
                        system.create_dir(parent)
                        made.add(parent)
                    system.move(info.path, goal)
                    n += 1
                moved.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(moved, pa.int64())], ["attempt", "n"])
    return run


def _remove(path):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    try:
        system.delete_dir(root)
    except OSError:      # it is gone, or a task writes to it just now
        pass


def write_files(df, path, text, file_name="file_name", folder=None):
    """Write column ``text`` of every row to ``path/folder/file_name`` in UTF-8.

    A null text is an empty file.  Names must be different: of rows with one name the last one moved stays.
    Files that are already there under other names stay.  If the job fails before all texts are staged,
    ``path`` is left as it was.
    """
    from pyarrow import fs

    spark, path = df.sparkSession, path.rstrip("/")
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    spark.dataSource.register(_staging_source())
    rows = df.select((F.col(folder) if folder else F.lit("")).cast("string").alias("folder"), F.col(file_name).cast("string").alias("file_name"), F.col(text).cast("string").alias("text"))
    try:
        rows.write.format(STAGED).mode("append").save(staging)
    except Exception:
        # Tasks that are being ended may still write after the sink has removed its files.
        for _ in range(10):
            _remove(staging)
            time.sleep(0.2)
        raise
    attempts = spark.read.text(posixpath.join(staging, "attempts.txt")).select(F.col("value").alias("attempt"))
    moved = attempts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)).mapInArrow(_moved(staging, path), "attempt string, n long")
    moved.agg(F.sum("n")).collect()
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.delete_dir(f"{root}/{staging.rsplit('/', 1)[1]}")
    with system.open_output_stream(f"{root}/_SUCCESS"):
        pass


def _hidden(name):
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _listed(deep):
    """Entries of folders: the first level as (folder, file), or all files below a folder."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for uri, folder, name in zip(*(c.to_pylist() for c in batch.columns)):
                system, root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
                waiting, found = [folder] if deep and folder and not name else [], []
                if not deep:
                    waiting = [""]
                elif name:
                    found.append((folder, name))
                while waiting:
                    below = waiting.pop()
                    for info in system.get_file_info(fs.FileSelector(f"{root}/{below}".rstrip("/"))):
                        if _hidden(info.base_name):
                            continue
                        if info.type == fs.FileType.Directory:
                            (waiting if deep else found).append(f"{below}/{info.base_name}".lstrip("/") if deep else (info.base_name, ""))
                        elif info.base_name.endswith(".md") and info.size:
                            found.append((below, info.base_name))
                for at in range(0, len(found), 10_000):
                    part = found[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(part), pa.string()), pa.array([f for f, _ in part], pa.string()), pa.array([n for _, n in part], pa.string())],
                                                     ["path", "folder", "file_name"])
    return run


def _texts(batches):
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        for at in range(0, len(rows), 256):      # so many texts are held at once
            folders, names, texts = [], [], []
            for uri, folder, name in rows[at:at + 256]:
                system, root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
                with system.open_input_file("/".join(x for x in (root, folder, name) if x)) as file:
                    texts.append(file.read().decode("utf-8", "replace"))
                folders.append((folder or root).rsplit("/", 1)[-1])
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array(names, pa.string()), pa.array(texts, pa.string())], ["folder", "file_name", "text"])


def read_files(spark, path):
    """folder, file_name, text of files that ``write_files`` wrote below ``path``.

    Tasks list the folders and open the files, so the driver holds no names; the number of tasks is that of
    a shuffle, not of the files.  Empty files give no row.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    columns = "path string, folder string, file_name string"
    root = spark.range(1, numPartitions=1).select(F.lit(path.rstrip("/")).alias("path"), F.lit("").alias("folder"), F.lit("").alias("file_name"))
    first = root.mapInArrow(_listed(False), columns).repartition(tasks, F.xxhash64("folder", "file_name"))
    names = first.mapInArrow(_listed(True), columns).repartition(tasks, F.xxhash64("folder", "file_name"))
    return names.mapInArrow(_texts, "folder string, file_name string, text string")
