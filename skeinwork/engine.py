"""SQL facade: role checks, KNN clauses, DML on snapshot tables, indexes, transactions, a cursor and a client.

Only KNN and DML are rewritten; queries go to Spark as they are. A statement is let through by its kind, and a query by
its parsed plan: every relation in it, subqueries and CTEs included, must be a table of the engine that the role may
read. Paths as relations, other views and catalogs, and functions that reach into the JVM are refused.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .access import AccessController
from .operators.index import SearchIndex
from .operators.vectors import CellIndex, embed, knn, register_functions
from .sources.snapshots import SnapshotTable
from .sources.staging import shared_dir, stage

CATEGORIES = {
    "DDL": {"CREATE", "DROP", "ALTER"}, "DQL": {"SELECT", "WITH"}, "DML": {"INSERT", "UPDATE", "DELETE"},
    "DCL": {"GRANT", "REVOKE"}, "TCL": {"BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT"},
}
_KNN = re.compile(r"\bKNN\s*\(\s*(\w+)\s*,\s*(\[[^\]]*\]|'[^']*')\s*,\s*(\d+)\s*\)", re.I)
_REFUSED = {"reflect", "java_method", "try_reflect"}
_SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression", "DynamicPruningSubquery"}
_TYPES = {"VARCHAR": "string", "TEXT": "string", "INT": "int", "INTEGER": "int", "FLOAT": "double", "JSON": "string", "VECTOR": "array<float>", "BOOLEAN": "boolean", "BIGINT": "bigint", "DOUBLE": "double"}


def category(statement: str) -> str:
    first = statement.strip().split(None, 1)[0].upper() if statement.strip() else ""
    return next((c for c, words in CATEGORIES.items() if first in words), "SQL")


@dataclass
class Result:
    """status, how many rows were met, and the rows of a query."""

    status: str
    count: int = 0
    rows: list[dict[str, Any]] | None = None


class Engine:
    """Tables are snapshot folders under one root; each also is a temp view of its name."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"
        self.access = AccessController()
        self.tables: dict[str, SnapshotTable] = {}
        self._open: dict[str, DataFrame] | None = None
        self._saved: dict[str, dict[str, DataFrame]] = {}
        self.indexes: dict[str, dict[str, Any]] = {}
        self._handlers = {k: getattr(self, f"_{k.lower()}") for k in ("CREATE", "DROP", "INSERT", "UPDATE", "DELETE", "GRANT", "REVOKE", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT")}
        register_functions(spark)

    def _guard(self, statement: str, role: str, args: list | None = None) -> None:
        """Raise unless every relation that a query names, wherever it stands, is a table of ours that the role may read."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
        seq = lambda s: [s.apply(i) for i in range(s.size())]
        ctes: set[str] = set()
        met: list[list[str]] = []
        open_, known = [plan], {n.lower(): n for n in self.tables}
        while open_:
            node = open_.pop()
            kind = node.getClass().getSimpleName()
            if kind == "UnresolvedRelation":
                met.append(seq(node.multipartIdentifier()))
            elif kind == "UnresolvedWith":
                for pair in seq(node.cteRelations()):
                    ctes.add(pair._1().lower())
                    open_.append(pair._2())
            elif kind == "UnresolvedFunction" and seq(node.nameParts())[-1].lower() in _REFUSED:
                raise PermissionError("that function can't be used here")
            elif kind in _SUBQUERIES:
                open_.append(node.plan())
            open_ += seq(node.children())
            if hasattr(node, "innerChildren") and not kind.startswith("Unresolved"):
                open_ += [x for x in seq(node.innerChildren()) if "plans" in x.getClass().getName()]
            if "plans" in node.getClass().getName():
                open_ += seq(node.expressions())
        for parts in met:
            name = parts[0].lower()
            if len(parts) == 1 and name in known:
                self.access.require(role, known[name], "SELECT")
            elif len(parts) > 1 or name not in ctes:
                raise PermissionError(f"no table {'.'.join(parts)} here")

    def attach(self, name: str, df: DataFrame) -> None:
        """Make df the first snapshot of a new table."""
        self.tables[name] = SnapshotTable(self.spark, f"{self.root}/{name}")
        self._store(name, df)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self._open[name] if self._open and name in self._open else self.tables[name].current()

    def _store(self, name: str, df: DataFrame) -> None:
        if self._open is not None:
            self._open[name] = df
        else:
            self.tables[name].write(df)
        self.table(name).createOrReplaceTempView(name)
        self._stale(name)

    def _stale(self, table: str) -> None:
        for held in self.indexes.values():
            if held["table"] == table:
                held["made"] = None

    def sql(self, statement: str, role: str = "admin", args: list | None = None) -> Result:
        text = statement.strip().rstrip(";")
        kind = text.split(None, 1)[0].upper() if text else ""
        if kind == "EXPLAIN":
            inner = re.sub(r"^EXPLAIN\s+(QUERY\s+PLAN\s+(FOR\s+)?|EXTENDED\s+|FORMATTED\s+|COST\s+|CODEGEN\s+)?", "", text, flags=re.I)
            if inner.split(None, 1)[0].upper() not in ("SELECT", "WITH", "VALUES"):
                raise PermissionError("only queries can be explained")
            self._guard(inner, role)
            mode = re.match(r"EXPLAIN\s+(EXTENDED|FORMATTED|COST|CODEGEN)?", text, re.I)[1] or ""
            lines = self.spark.sql(f"EXPLAIN {mode} {inner}", args=args or []).first()[0].splitlines()
            return Result("ok", len(lines), [{"addr": i, "step": x} for i, x in enumerate(lines)])
        if kind in self._handlers:
            return self._handlers[kind](text, role, args or [])
        if re.fullmatch(r"SHOW\s+TABLES", text, re.I):
            names = sorted(n for n in self.tables if self.access.check_permission(role, n, "SELECT"))
            return Result("ok", len(names), [{"name": n} for n in names])
        if kind in ("SELECT", "WITH", "VALUES"):
            return self._query(text, role, args or [])
        raise PermissionError(f"{kind or 'an empty statement'} is not allowed here")

    def frame(self, statement: str, role: str = "admin", args: list | None = None) -> DataFrame:
        """A query's DataFrame; role checks come before analysis."""
        self._guard(_KNN.sub("true", statement), role)
        if not (m := _KNN.search(statement)):
            return self.spark.sql(statement, args=args or [])
        column, query, k = m[1], m[2], int(m[3])
        source = re.search(r"\bFROM\s+(\w+)", statement, re.I)[1]
        vector = embed(query[1:-1]) if query[0] == "'" else [float(x) for x in query[1:-1].split(",")]
        rows = self.table(source).withColumn("_row", F.monotonically_increasing_id())
        near = knn(rows, self.spark.createDataFrame([(vector,)], "v array<double>"), k, key="_row", vector=column)
        view = f"knn_{uuid.uuid4().hex}"
        rows.join(F.broadcast(near), "_row").drop("_row").createOrReplaceTempView(view)  # k rows
        rest = _KNN.sub("true", statement, 1)
        rest = re.sub(rf"\bFROM\s+{source}\b", f"FROM {view}", rest, count=1, flags=re.I)
        if not re.search(r"\bORDER\s+BY\b", rest, re.I):
            cut = re.search(r"\bLIMIT\b", rest, re.I)
            rest = f"{rest[: cut.start()]} ORDER BY score DESC {rest[cut.start() :]}" if cut else f"{rest} ORDER BY score DESC"
        return self.spark.sql(rest, args=args or [])

    def _query(self, text: str, role: str, args: list) -> Result:
        rows = [r.asDict(True) for r in self.frame(text, role, args).collect()]
        return Result("ok", len(rows), rows)

    def _create(self, text: str, role: str, args: list) -> Result:
        if m := re.match(r"CREATE\s+INDEX\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+(\w+)\s*(?:USING\s+(\w+)\s*)?\(\s*(\w+)\s*\)(?:\s+USING\s+(\w+))?$", text, re.I):
            return self._create_index(m[2], m[3], (m[4] or m[6] or "BTREE").upper(), m[5], role, bool(m[1]))
        m = re.match(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)$", text, re.I | re.S)
        if not m:
            raise PermissionError("only tables and indexes can be created")
        self.access.require(role, m[2], "CREATE")
        if m[2] in self.tables:
            if m[1]:
                return Result("ok")
            raise ValueError(f"table {m[2]} exists")
        fields = [x.split()[:2] for x in re.split(r",(?![^(]*\))", m[3])]
        schema = ", ".join(f"{n} {_TYPES[re.match(r'[A-Za-z]+', t)[0].upper()]}" for n, t in fields)
        self.attach(m[2], self.spark.createDataFrame([], schema))
        return Result("ok")

    def _create_index(self, name: str, table: str, kind: str, column: str, role: str, if_missing: bool) -> Result:
        self.access.require(role, table, "CREATE")
        if name in self.indexes:
            if if_missing:
                return Result("ok")
            raise ValueError(f"index {name} exists")
        if kind not in ("INVERTED", "HNSW", "BTREE"):
            raise ValueError(f"no index kind {kind}")
        if column not in self.table(table).columns:
            raise KeyError(f"no column {column}")
        self.indexes[name] = {"table": table, "kind": kind, "column": column, "made": None}
        self.index(name, role)
        return Result("ok")

    def index(self, name: str, role: str = "admin") -> SearchIndex | CellIndex | DataFrame:
        """An index, made anew if its table changed since: INVERTED gives the stored postings, HNSW the cells of an
        approximate vector index, BTREE a copy of the table in order of the column, whose scans skip by its statistics."""
        held = self.indexes[name]
        self.access.require(role, held["table"], "SELECT")
        if held["made"] is None:
            rows, column = self.table(held["table"]), held["column"]
            if held["kind"] == "INVERTED":
                held["made"] = SearchIndex.build(rows, f"{self.root}/index-{name}-{uuid.uuid4().hex}", rows.columns[0], {column: column})
            elif held["kind"] == "HNSW":
                held["made"] = CellIndex(rows, key=rows.columns[0], vector=column)
            else:
                held["made"] = stage(rows.repartitionByRange(column).sortWithinPartitions(column), "btree")
        return held["made"]

    def _drop(self, text: str, role: str, args: list) -> Result:
        if m := re.match(r"DROP\s+INDEX\s+(IF\s+EXISTS\s+)?(\w+)$", text, re.I):
            if m[2] in self.indexes:
                self.access.require(role, self.indexes[m[2]]["table"], "DROP")
                del self.indexes[m[2]]
            elif not m[1]:
                raise KeyError(f"no index {m[2]}")
            return Result("ok")
        m = re.match(r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?(\w+)$", text, re.I)
        self.access.require(role, m[2], "DROP")
        if m[2] not in self.tables and not m[1]:
            raise KeyError(f"no table {m[2]}")
        self.indexes = {n: x for n, x in self.indexes.items() if x["table"] != m[2]}
        if self.tables.pop(m[2], None):
            self.spark.catalog.dropTempView(m[2])
        return Result("ok")

    def _insert(self, text: str, role: str, args: list) -> Result:
        m = re.match(r"INSERT\s+(?:OR\s+REPLACE\s+)?INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*(VALUES.*|SELECT.*)$", text, re.I | re.S)
        self.access.require(role, m[1], "INSERT")
        self._guard(m[3], role)
        base = self.table(m[1])
        names = [x.strip() for x in m[2].split(",")] if m[2] else base.columns
        new = self.spark.sql(m[3] if m[3][:6].upper() == "SELECT" else f"SELECT * FROM ({m[3]})", args=args).toDF(*names)
        shaped = new.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in base.schema])
        n = shaped.count()
        if re.match(r"INSERT\s+OR\s+REPLACE", text, re.I):
            base = base.join(shaped.select(base.columns[0]), base.columns[0], "left_anti")
        self._store(m[1], base.unionByName(shaped))
        return Result("ok", n)

    def _update(self, text: str, role: str, args: list) -> Result:
        m = re.match(r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?$", text, re.I | re.S)
        self.access.require(role, m[1], "UPDATE")
        self._guard(f"SELECT {', '.join(x.partition('=')[2] for x in re.split(r',(?=\s*\w+\s*=)', m[2]))} WHERE {m[3] or 'true'}", role)  # subqueries' tables
        base, where = self.table(m[1]), F.coalesce(F.expr(m[3] or "true"), F.lit(False))
        n = base.filter(where).count()
        sets = dict(re.match(r"\s*(\w+)\s*=\s*(.*)", x, re.S).groups() for x in re.split(r",(?=\s*\w+\s*=)", m[2]))
        self._store(m[1], base.select(*[F.when(where, F.expr(sets[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in sets else F.col(f.name) for f in base.schema]))
        return Result("ok", n)

    def _delete(self, text: str, role: str, args: list) -> Result:
        m = re.match(r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$", text, re.I | re.S)
        self.access.require(role, m[1], "DELETE")
        self._guard(f"SELECT 1 WHERE {m[2] or 'true'}", role)
        base, where = self.table(m[1]), F.coalesce(F.expr(m[2] or "true"), F.lit(False))
        n = base.filter(where).count()
        self._store(m[1], base.filter(~where))
        return Result("ok", n)

    def _grant(self, text: str, role: str, args: list) -> Result:
        m = re.match(r"GRANT\s+(\w+)\s+ON\s+(\S+)\s+TO\s+(\w+)$", text, re.I)
        self.access.require(role, m[2], "GRANT")
        self.access.grant(m[3], m[2], m[1])
        return Result("ok")

    def _revoke(self, text: str, role: str, args: list) -> Result:
        m = re.match(r"REVOKE\s+(\w+)\s+ON\s+(\S+)\s+FROM\s+(\w+)$", text, re.I)
        self.access.require(role, m[2], "GRANT")
        self.access.revoke(m[3], m[2], m[1])
        return Result("ok")

    def _begin(self, *_) -> Result:
        if self._open is not None:
            raise RuntimeError("a transaction is active")
        self._open, self._saved = {}, {}
        return Result("ok")

    def _savepoint(self, text: str, *_) -> Result:
        if self._open is None:
            raise RuntimeError("no transaction is active")
        self._saved[text.split()[1]] = dict(self._open)
        return Result("ok")

    def _end(self, keep: dict[str, DataFrame]) -> Result:
        touched, self._open = self._open, None
        for name, df in keep.items():
            self.tables[name].write(df)
        for name in touched:
            self.table(name).createOrReplaceTempView(name)
            self._stale(name)
        return Result("ok", len(keep))

    def _commit(self, *_) -> Result:
        if self._open is None:
            raise RuntimeError("no transaction is active")
        return self._end(self._open)

    def _rollback(self, text: str, *_) -> Result:
        if self._open is None:
            raise RuntimeError("no transaction is active")
        if m := re.match(r"ROLLBACK\s+TO\s+(?:SAVEPOINT\s+)?(\w+)$", text, re.I):
            touched, self._open = self._open, dict(self._saved[m[1]])
            for name in touched:
                self.table(name).createOrReplaceTempView(name)
            return Result("ok")
        return self._end({})

    def cursor(self, role: str = "admin") -> Cursor:
        return Cursor(self, role)


class Cursor:
    """DB-API style: execute with ? placeholders, then fetch tuples."""

    def __init__(self, engine: Engine, role: str):
        self.engine, self.role, self.rowcount, self._rows = engine, role, -1, []

    def execute(self, statement: str, args: tuple | list = ()) -> Cursor:
        r = self.engine.sql(statement, self.role, list(args))
        self.rowcount, self._rows = r.count, [tuple(x.values()) for x in r.rows or []]
        return self

    def fetchone(self) -> tuple | None:
        return self._rows.pop(0) if self._rows else None

    def fetchall(self) -> list[tuple]:
        out, self._rows = self._rows, []
        return out


class VectorClient:
    """Vectors with metadata by id: bulk writes, point reads, neighbours by vector or text."""

    SCHEMA = "id string, vector array<double>, metadata map<string,string>"

    def __init__(self, engine: Engine, name: str = "vectors"):
        self.engine, self.name = engine, name
        engine.attach(name, engine.spark.createDataFrame([], self.SCHEMA))

    def ping(self) -> bool:
        return self.engine.spark.range(1).count() == 1

    def info(self) -> dict:
        return {"table": self.name, "rows": self.engine.table(self.name).count()}

    def insert(self, key: str, vector: list[float], metadata: dict[str, str] | None = None) -> int:
        """One vector, in place of the one with its id."""
        return self.bulk_write([(key, [float(x) for x in vector], metadata or {})])

    def bulk_write(self, rows: list[tuple]) -> int:
        new = self.engine.spark.createDataFrame(rows, self.SCHEMA)
        self.engine._store(self.name, self.engine.table(self.name).join(new.select("id"), "id", "left_anti").unionByName(new))
        return len(rows)

    def get_by_id(self, key: str) -> dict | None:
        found = self.engine.table(self.name).filter(F.col("id") == key).limit(1).collect()
        return found[0].asDict(True) if found else None

    def search_knn(self, query: list[float] | str, k: int = 10) -> DataFrame:
        vector = embed(query) if isinstance(query, str) else [float(x) for x in query]
        return knn(self.engine.table(self.name), self.engine.spark.createDataFrame([(vector,)], "v array<double>"), k, key="id", vector="vector")

    def execute_sql(self, statement: str, role: str = "admin") -> Result:
        return self.engine.sql(statement, role)
