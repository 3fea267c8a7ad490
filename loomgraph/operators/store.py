"""A store of named statements with atomic commits.

With a path, each commit is a folder of Parquet files and a pointer file names the
commits that count; the pointer is replaced by a rename, so a failed commit leaves
no trace. Without a path, statements are kept as DataFrames of the session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import GraphError, StoreConfig, StoreSetupError
from loomgraph.functions.terms import TRIPLE
from loomgraph.functions.vocab import check_names
from loomgraph.operators.fold import Graph, graph_of, statements


class GraphStore:
    """Collects triples, commits them as statements, and gives the graph they make.

    :param path: a folder on any file system Spark can reach; exclusive with ``in_memory``.
    """

    def __init__(self, spark: SparkSession, config: StoreConfig, path: str | None = None, in_memory: bool = False):
        if (path is None) == (not in_memory):
            raise StoreSetupError("give either a path or in_memory=True")
        self.spark, self.config, self.path = spark, config, path.rstrip("/") if path else None
        self.total_triples = 0
        self._open = False
        self._pending: list[DataFrame] = []
        self._pending_edges: list[DataFrame] = []
        self._rows: list[tuple] = []
        self._added: dict[int, DataFrame] = {}  # batches of triples that were counted when they were added
        self._batches: list[str] = []
        self._memory: list[DataFrame] = []
        self._state = {"seq": 0, "commits": []}
        self._seen: dict | None = None  # what the pointer file last said

    # life cycle

    def open(self, create: bool = True) -> GraphStore:
        """Read the pointer file, or start an empty store if ``create``."""
        if self.path:
            found = self._seen = self._read_pointer()
            if found is None and not create:
                raise GraphError(f"no store at {self.path}")
            if found is None:
                self._write_pointer(self._state)
            else:
                self._state = found
        self._open = True
        return self

    def close(self, commit_pending: bool = True) -> int:
        """Commit (or discard) what is pending and return the number of triples taken since opening."""
        if commit_pending:
            self.commit()
        self._discard()
        self._open = False
        taken, self.total_triples = self.total_triples, 0
        return taken

    def is_open(self) -> bool:
        return self._open

    def __enter__(self) -> GraphStore:
        return self.open()

    def __exit__(self, kind, value, trace) -> None:
        self.close(commit_pending=kind is None)

    # input

    def add(self, triple: tuple, context: str | None = None, quoted: bool = False) -> None:
        """One triple (subject, predicate, object) of terms: an IRI as text, ``("bnode", id)`` or ``("literal", text[, datatype[, lang]])``.

        ``context`` names its graph, which is kept with the triple and has no part in the merge; ``quoted`` has no effect.
        The driver holds ``batch_size`` triples at most (with ``batching``) and hands them over in batches.
        """
        self._need_open()
        s, p, o = triple
        subj_kind, subj = ("iri", s) if isinstance(s, str) else (s[0], s[1])
        obj_kind, obj, *rest = ("iri", o) if isinstance(o, str) else o
        dtype, lang = (*rest, None, None)[:2]
        self._rows.append((("", 0, self.total_triples), subj, subj_kind, p, obj, obj_kind, dtype, lang, context))
        self.total_triples += 1
        if self.config.batching and len(self._rows) >= self.config.batch_size:
            self._seal_rows()

    def add_all(self, triples: DataFrame | Iterable[tuple]) -> None:
        """A DataFrame of triples, or an iterable for :meth:`add`."""
        self._need_open()
        if not isinstance(triples, DataFrame):
            for t in triples:
                self.add(t)
            return
        self._seal_rows()
        self._pending.append(triples.select(*TRIPLE.names))

    def parse(self, source: str | None = None, data: str | None = None, format: str | None = None) -> None:  # noqa: A002
        """Files (by path; the format is guessed from the name) or inline text."""
        from loomgraph.sources import read_data, read_files

        if (source is None) == (data is None):
            raise GraphError("give either source or data")
        self.add_all(read_data(self.spark, data, format or "turtle") if source is None else read_files(self.spark, source, format))

    def remove(self, triple: tuple) -> None:
        raise NotImplementedError("statements can't be removed")

    # commit

    def last_batch(self, stream: str) -> int:
        """Number of the last committed batch of a stream, -1 before the first."""
        return self._state.get("batches", {}).get(stream, -1)

    def commit(self, commit_nodes: bool = False, commit_rels: bool = False, batch: tuple[str, int] | None = None) -> None:
        """Commit labels and properties, relationships, or both (neither or both flags). What isn't committed stays pending.

        ``batch`` is a stream's name and batch number, noted in the same write as the commit.
        Names are checked before anything is written; on any error the pending triples are dropped and the store is as before.
        """
        self._need_open()
        before = self._state
        if batch:
            self._state = {**before, "batches": {**before.get("batches", {}), batch[0]: batch[1]}}
        only_nodes, only_rels = commit_nodes and not commit_rels, commit_rels and not commit_nodes
        self._seal_rows()
        if not self._pending and not self._pending_edges:
            return
        seq = self._state["seq"] + 1
        try:
            logs = list(self._pending_edges)
            for n, triples in enumerate(self._pending):
                check_names(triples, self.config)
                log = statements(triples, self.config, seq)
                # later additions of one commit come after earlier ones
                logs.append(log.withColumn("ord", F.col("ord").withField("file", F.concat(F.lit(f"{n:08d} "), F.coalesce("ord.file", F.lit(""))))))
            counted = sum(t.count() for t in self._pending if id(t) not in self._added)
            log = logs[0]
            for more in logs[1:]:
                log = log.unionByName(more)
            is_edge = F.col("kind") == "edge"
            later = []
            if only_nodes:
                later, log = [log.filter(is_edge)], log.filter(~is_edge)
            elif only_rels:
                later, log = [log.filter(~is_edge)], log.filter(is_edge)
            self._write(log, seq)
        except Exception:
            self._discard()
            self._state = before
            raise
        self.total_triples += counted
        if later and self._batches:  # what stays pending is read once more
            later = [x.persist() for x in later]
            for x in later:
                x.count()
        self._drop_batches()
        self._pending, self._pending_edges = [], later

    def _write(self, log: DataFrame, seq: int) -> None:
        """Write the commit, check the arrays it adds to, and only then name it in the pointer file."""
        if not self.path:
            log = log.persist()  # made again from its source if an executor is lost
            try:
                self._check_arrays(log, [*self._memory, log])
            except Exception:
                log.unpersist()
                raise
            self._memory.append(log)
            self._state = {**self._state, "seq": seq}
            return
        folder = f"log/{seq:08d}-{uuid.uuid4().hex}"
        try:
            log.write.parquet(f"{self.path}/{folder}")
            state = {**self._state, "seq": seq, "commits": [*self._state["commits"], folder]}
            self._check_arrays(self._read([folder]), self._parts(state))
            self._write_pointer(state)
        except Exception:
            self._delete(folder)
            raise
        self._state = state

    def _check_arrays(self, new: DataFrame, parts: list[DataFrame]) -> None:
        """Only properties that the new commit makes an array are looked up in earlier commits."""
        arrays = new.filter("multi").select("uri", "name").distinct()
        if arrays.isEmpty():
            return
        graph_of(self._log_of(parts).filter("kind = 'prop'").join(arrays, ["uri", "name"], "left_semi")).check_arrays()

    def compact(self) -> None:
        """Write the log anew without statements that no longer matter, sorted by uri, as one commit."""
        log = self._log_of(self._parts(self._state))
        label_or_edge = log.filter("kind <> 'prop'").groupBy("kind", "uri", "name", "value", "multi", "dst").agg(F.min("ord").alias("ord"))
        props = log.filter("kind = 'prop'").groupBy("kind", "uri", "name", "value", "multi", "dst").agg(F.min("ord").alias("a"), F.max("ord").alias("b"))
        props = props.withColumn("ord", F.explode(F.array_distinct(F.array("a", "b")))).drop("a", "b")
        small = label_or_edge.unionByName(props).select(*log.columns)
        if not self.path:
            self._memory = [small]
            return
        folder = f"log/base-{self._state['seq']:08d}-{uuid.uuid4().hex}"
        small.repartitionByRange("uri").sortWithinPartitions("uri").write.parquet(f"{self.path}/{folder}")
        state = {**self._state, "commits": [folder]}
        self._write_pointer(state)
        self._state = state

    def clear(self) -> None:
        """Delete everything: the store goes on empty."""
        self._discard()
        self._memory = []
        self._state = {**self._state, "commits": []}
        if self.path:
            self._write_pointer(self._state)

    # output

    def graph(self) -> Graph:
        """The graph of all committed statements."""
        return self._graph(self._state)

    def num_nodes(self) -> int:
        return self.graph().node_ids.count()

    def num_edges(self) -> int:
        return self.graph().edges.count()

    def __len__(self) -> int:
        return 0  # triples aren't kept, so none can be counted

    def __bool__(self) -> bool:
        return True

    # inside

    def _need_open(self) -> None:
        if not self._open:
            raise GraphError("the store isn't open")

    def _seal_rows(self) -> None:
        """Hand the triples added one by one over as a DataFrame: with a path, as files of the store."""
        if not self._rows:
            return
        batch = self.spark.createDataFrame(self._rows, TRIPLE)
        if self.path:
            folder = f"pending/{uuid.uuid4().hex}"
            batch.coalesce(1).write.parquet(f"{self.path}/{folder}")
            batch = self.spark.read.schema(TRIPLE).parquet(f"{self.path}/{folder}")
            self._batches.append(folder)
        self._added[id(batch)] = batch
        self._pending.append(batch)
        self._rows = []

    def _drop_batches(self) -> None:
        for folder in self._batches:
            self._delete(folder)
        self._batches, self._added = [], {}

    def _discard(self) -> None:
        self._drop_batches()
        self._pending, self._pending_edges, self._rows = [], [], []

    def _delete(self, folder: str) -> None:
        p, fs = self._fs(folder)
        fs.delete(p, True)

    def _empty_log(self) -> DataFrame:
        return statements(self.spark.createDataFrame([], TRIPLE), StoreConfig())

    def _log_of(self, parts: list[DataFrame]) -> DataFrame:
        log = self._empty_log()
        for p in parts:
            log = log.unionByName(p)
        return log

    def _parts(self, state: dict) -> list[DataFrame]:
        if not self.path:
            return self._memory
        if not state["commits"]:
            return []
        return [self._read(state["commits"])]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self._empty_log().schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _graph(self, state: dict) -> Graph:
        return graph_of(self._log_of(self._parts(state)))

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_pointer(self) -> dict | None:
        p, fs = self._fs("CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_pointer(self, state: dict) -> None:
        """Replace the pointer file, unless someone else has since this store read or wrote it."""
        if self._read_pointer() != self._seen:
            raise GraphError(f"another writer has changed the store at {self.path}")
        new, fs = self._fs(f".CURRENT-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        old, _ = self._fs("CURRENT")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, old, options)
        self._seen = state
