from __future__ import annotations

import socket
import struct
import threading

import pytest

from quernlake import dbapi
from quernlake.pgserver import Server


def test_dbapi(spark):
    with dbapi.connect(spark) as c:
        cur = c.cursor()
        cur.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
        assert cur.executemany("INSERT INTO t (id, v) VALUES (?, ?)", [(1, "a"), (2, "b'\\")]).rowcount == 2
        cur.execute("SELECT id, v FROM t ORDER BY id")
        assert [d[0] for d in cur.description] == ["id", "v"]
        assert cur.fetchone() == (1, "a") and cur.fetchall() == [(2, "b'\\")]
        with pytest.raises(dbapi.IntegrityError):
            cur.execute("INSERT INTO t VALUES (1, 'x')")
        with pytest.raises(dbapi.ProgrammingError):
            cur.execute("SELECT ? FROM t")
        with pytest.raises(dbapi.OperationalError):
            cur.execute("SELECT nope FROM t")
        c.begin("SNAPSHOT")
        cur.execute("DELETE FROM t")
        c.rollback()
        assert cur.execute("SELECT COUNT(*) FROM t").fetchone() == (2,)


def read(f):
    kind = f.read(1)
    return kind, f.read(struct.unpack("!i", f.read(4))[0] - 4)


def test_wire(spark):
    server = Server(spark, "memory://", ("127.0.0.1", 0))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with socket.create_connection(server.server_address) as s, s.makefile("rb") as f:
        s.sendall(struct.pack("!ii", 8, 80877103))
        assert f.read(1) == b"N"
        body = struct.pack("!i", 196608) + b"user\0me\0\0"
        s.sendall(struct.pack("!i", len(body) + 4) + body)
        while read(f)[0] != b"Z":
            pass

        def ask(sql):
            s.sendall(b"Q" + struct.pack("!i", len(sql) + 5) + sql.encode() + b"\0")
            out = []
            while True:
                out.append(read(f))
                if out[-1][0] == b"Z":
                    return out

        assert ask("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (7), (NULL)")[1] == (b"C", b"INSERT 0 2\0")
        got = ask("SELECT a FROM t ORDER BY a")
        assert [k for k, _ in got] == [b"T", b"D", b"D", b"C", b"Z"]
        assert got[1][1] == struct.pack("!hi", 1, 1) + b"7" and got[2][1] == struct.pack("!hi", 1, -1)
        assert ask("SELECT nope")[0][0] == b"E"
    server.shutdown()
    server.server_close()
