import random

import pytest

from sheaf.sources.records import read_records


def written(tmp_path, *bodies):
    for i, body in enumerate(bodies):
        (tmp_path / f"f{i}.csv").write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(tmp_path)


def read(spark, path, key="ID"):
    records, violations = read_records(spark, path, key)
    got = sorted((r["file"][-6:-4], r["record_no"], r["physical_row"], r["key"], dict(r["cells"])) for r in records.collect())
    return got, sorted((v["file"][-6:-4], v["physical_row"], v["reason"]) for v in violations.collect())


def test_quoted_cells_and_physical_lines(spark, tmp_path):
    got, bad = read(spark, written(tmp_path, 'ID,Name\r\n0012,"Ada, ""A""\r\nPublic"\r\n0020,Ben\r\n', "﻿ID,Other\n1,x\n2,\n"))
    assert got == [("f0", 1, 2, "0012", {"ID": "0012", "Name": 'Ada, "A"\r\nPublic'}), ("f0", 2, 4, "0020", {"ID": "0020", "Name": "Ben"}),
                   ("f1", 1, 2, "1", {"ID": "1", "Other": "x"}), ("f1", 2, 3, "2", {"ID": "2", "Other": ""})]
    assert bad == []


@pytest.mark.parametrize("body, want", [
    ('ID,N\nA,"bad', [(2, "unterminated-quote")]), ('ID,N\nA,"x" junk\nB,y', [(2, "malformed-quote")]), ("ID,N\nA,x,y", [(2, "width")]),
    ('ID,N\nA,x"', [(2, "malformed-quote")]), ('ID,N\n"A"x,y\n\nB,z', [(2, "malformed-quote"), (3, "width")]), ("ID,N\n,x", [(2, "blank-key")]),
    ("ID,N\nA,x\n A ,y", [(2, "duplicate-key"), (3, "duplicate-key")]), ("ID,N\né,x\né,y", [(2, "duplicate-key"), (3, "duplicate-key")]),
    ("ID,ID\nA,x", [(1, "header")]), ("ID,\nA,x", [(1, "header")]), ("K,N\nA,x", [(1, "key-column")]), ("ID,N\n", [(1, "no-records")]), ("", []),
    (b"ID,N\nA,\xff\nB,y", [(2, "encoding")]), ("ID,N\r1,a\r2,\"x\ry\"\r3,b,c", [(5, "width")]), ('ID,N\nA,"x\n\n\ny"\nB,"z', [(6, "unterminated-quote")]),
])
def test_violations_carry_true_lines(spark, tmp_path, body, want):
    assert [v[1:] for v in read(spark, written(tmp_path, body))[1]] == want


def plain(text):
    """Records of a sound text, character by character: (line, cells)."""
    out, cells, value, inside, line, start, i = [], [], "", False, 1, 1, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1:i + 2] == '"':
                value, i = value + '"', i + 1
            elif c == '"':
                inside = False
            else:
                value += c
                line += c == "\n" or c == "\r" and text[i + 1:i + 2] != "\n"
        elif c == '"':
            inside = True
        elif c == ",":
            cells, value = cells + [value], ""
        elif c in "\r\n":
            i += c == "\r" and text[i + 1:i + 2] == "\n"
            out, cells, value, line = out + [(start, cells + [value])], [], "", line + 1
            start = line
        else:
            value += c
        i += 1
    return out + ([(start, cells + [value])] if cells or value else [])


def test_one_file_in_many_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [["ID", "a", "b"]]
    for i in range(1500):
        rows.append([f"k{i}", *["".join(rng.choice(['"', ",", "\n", "\r", "\r\n", "x", "é", " ", "\x01b"]) for _ in range(rng.randrange(9))) for _ in range(2)]])
    breaks = [rng.choice(["\n", "\r\n", "\r"]) for _ in rows]
    text = "".join(",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\r\n') or rng.random() < 0.2 else c for c in r) + e for r, e in zip(rows, breaks))
    path = written(tmp_path, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        got, bad = read(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = plain(text)[1:]
    assert bad == [] and len(got) == 1500
    assert [(g[2], [g[4][h] for h in ("ID", "a", "b")]) for g in sorted(got, key=lambda g: g[2])] == want
