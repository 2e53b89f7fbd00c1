"""A DB-API 2.0 front of the engine: ``connect(spark, dsn).cursor().execute(sql, params)``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quernlake.plans.engine import Engine
from quernlake.plans.lexer import SyntaxProblem
from quernlake.sources.versioned import ConflictError, ConstraintError, DatabaseError

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    pass


class ProgrammingError(Error):
    pass


class IntegrityError(Error):
    pass


class OperationalError(Error):
    pass


class Connection:
    """Changes commit by themselves unless ``begin`` opened a transaction."""

    def __init__(self, spark: SparkSession, dsn: str = "memory://"):
        self.engine = Engine(spark, dsn)

    def cursor(self) -> Cursor:
        return Cursor(self)

    def begin(self, isolation: str | None = None) -> None:
        self.engine.begin(isolation)

    def commit(self) -> None:
        if self.engine.transaction:
            _guarded(self.engine.commit)

    def rollback(self) -> None:
        if self.engine.transaction:
            self.engine.rollback()

    def close(self) -> None:
        self.engine.close()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()
        self.close()


def _guarded(call, *args):
    try:
        return call(*args)
    except (ConstraintError, ConflictError) as e:
        raise IntegrityError(str(e)) from e
    except (SyntaxProblem, DatabaseError, ValueError) as e:
        raise ProgrammingError(str(e)) from e
    except PySparkException as e:
        raise OperationalError(str(e)) from e


class Cursor:
    arraysize = 100

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount, self.lastrowid = connection, None, -1, None
        self._rows: Iterator = iter(())

    def execute(self, text: str, params: Sequence = ()) -> Cursor:
        prepared = _guarded(self.connection.engine.prepare, text)
        for ts in prepared.statements:
            got = _guarded(self.connection.engine._statement, ts, list(params))
            if isinstance(got, DataFrame):
                self.description = [(f.name, f.dataType.typeName(), None, None, None, None, f.nullable) for f in got.schema]
                self._rows, self.rowcount = _guarded(got.toLocalIterator), -1  # a partition at a time
            else:
                self.description, self._rows, self.rowcount, self.lastrowid = None, iter(()), got.rows_affected, got.last_insert_id
        return self

    def executemany(self, text: str, many: Sequence[Sequence]) -> Cursor:
        total = 0
        for params in many:
            total += max(0, self.execute(text, params).rowcount)
        self.rowcount = total
        return self

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [tuple(r) for _, r in zip(range(size or self.arraysize), self._rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def __iter__(self):
        return (tuple(r) for r in self._rows)

    def close(self) -> None:
        self._rows = iter(())


def connect(spark: SparkSession, dsn: str = "memory://") -> Connection:
    return Connection(spark, dsn)
