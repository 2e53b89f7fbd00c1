"""The PostgreSQL simple-query protocol over an engine, so that its command-line clients can connect.

Each connection has a session of its own over the same database. Values travel as text. The extended protocol is
answered with an error.
"""

from __future__ import annotations

import argparse
import socketserver
import struct

from pyspark.sql import DataFrame, SparkSession

from quernlake.plans.engine import Engine
from quernlake.plans.lexer import Token, statements
from quernlake.session import build

#: Type ids of the protocol.
OIDS = {"bigint": 20, "int": 23, "double": 701, "boolean": 16, "timestamp_ntz": 1114, "timestamp": 1114, "string": 25}
SSL_REQUEST, STARTUP = 80877103, 196608


def message(kind: bytes, body: bytes = b"") -> bytes:
    return kind + struct.pack("!i", len(body) + 4) + body


def text(s: str) -> bytes:
    return s.encode() + b"\0"


def value(v) -> bytes:
    if v is None:
        return struct.pack("!i", -1)
    raw = ("t" if v else "f").encode() if isinstance(v, bool) else str(v).encode()
    return struct.pack("!i", len(raw)) + raw


def error(e: Exception) -> bytes:
    return message(b"E", b"SERROR\0C42000\0M" + text(str(e).split("\n")[0]) + b"\0")


def tag(ts: list[Token], n: int) -> str:
    head = ts[0].upper
    return f"INSERT 0 {n}" if head == "INSERT" else f"{head} {n}" if head in ("UPDATE", "DELETE", "MERGE") else head


class Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        if not self._startup():
            return
        engine = Engine(self.server.spark, self.server.dsn)
        skipping = False  # after an error in the extended protocol, all up to Sync
        try:
            while kind := self.rfile.read(1):
                body = self.rfile.read(struct.unpack("!i", self.rfile.read(4))[0] - 4)
                if kind == b"X":
                    break
                if skipping and kind != b"S":
                    continue
                if kind == b"Q":
                    self._query(engine, body.rstrip(b"\0").decode())
                elif kind == b"S":
                    skipping = False
                    self._ready(engine)
                elif kind in b"PBDEC":
                    skipping = True
                    self.wfile.write(error(ValueError("the extended protocol isn't served")))
        finally:
            engine.close()

    def _startup(self) -> bool:
        while True:
            head = self.rfile.read(8)
            if len(head) < 8:
                return False
            size, code = struct.unpack("!ii", head)
            self.rfile.read(size - 8)
            if code == SSL_REQUEST:
                self.wfile.write(b"N")
                continue
            if code != STARTUP:
                return False
            self.wfile.write(message(b"R", struct.pack("!i", 0)))
            for k, v in (("server_version", "14.0"), ("client_encoding", "UTF8"), ("TimeZone", "UTC")):
                self.wfile.write(message(b"S", text(k) + text(v)))
            self.wfile.write(message(b"Z", b"I"))
            return True

    def _ready(self, engine: Engine) -> None:
        self.wfile.write(message(b"Z", b"T" if engine.transaction else b"I"))

    def _query(self, engine: Engine, sql: str) -> None:
        try:
            found = statements(sql)
            if not found:
                self.wfile.write(message(b"I"))
            for ts in found:
                got = engine._statement(ts, ())
                n = self._rows(got) if isinstance(got, DataFrame) else got.rows_affected
                self.wfile.write(message(b"C", text(f"SELECT {n}" if isinstance(got, DataFrame) else tag(ts, n))))
        except Exception as e:  # the connection goes on after errors
            self.wfile.write(error(e))
        self._ready(engine)

    def _rows(self, df: DataFrame) -> int:
        cols = b"".join(text(c) + struct.pack("!ihihih", 0, 0, OIDS.get(k, 25), -1, -1, 0) for c, k in df.dtypes)
        self.wfile.write(message(b"T", struct.pack("!h", len(df.columns)) + cols))
        n = 0
        for row in df.toLocalIterator():  # a partition at a time
            self.wfile.write(message(b"D", struct.pack("!h", len(row)) + b"".join(map(value, row))))
            n += 1
        return n


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address, daemon_threads = True, True

    def __init__(self, spark: SparkSession, dsn: str, address: tuple[str, int] = ("127.0.0.1", 5432)):
        self.spark, self.dsn = spark, Engine(spark, dsn).store.files.root
        super().__init__(address, Handler)


def main() -> None:
    p = argparse.ArgumentParser(prog="quernlake.pgserver", description=__doc__)
    p.add_argument("-d", "--db", default="memory://")
    p.add_argument("-b", "--bind", default="127.0.0.1:5432")
    a = p.parse_args()
    host, _, port = a.bind.rpartition(":")
    Server(build(), a.db, (host, int(port))).serve_forever()


if __name__ == "__main__":
    main()
