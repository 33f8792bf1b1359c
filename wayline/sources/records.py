"""Game records: parsing of one record's text, folders of records, concatenated records, and position tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import boards

_PROPERTY = re.compile(r"([A-Z]{1,2})((?:\s*\[(?:\\.|[^\]\\])*\])+)", re.S)
_VALUE = re.compile(r"\[((?:\\.|[^\]\\])*)\]", re.S)
#: Positions of a table that a task hands on: without boards, and with them for each board.
BATCH_POSITIONS = 4_096


def _nodes(text: str) -> list[dict[str, list[str]]]:
    """Nodes of the main variation: at each branching the first child."""
    nodes, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == ";":
            nodes.append({})
            i += 1
        elif c == ")":
            break  # the first variation's end is the main line's end
        elif c.isupper() and nodes and (m := _PROPERTY.match(text, i)):
            nodes[-1].setdefault(m[1], []).extend(v.replace("\\]", "]").replace("\\\\", "\\") for v in _VALUE.findall(m[2]))
            i = m.end()
        else:
            i += 1
    return nodes


def _point(value: str, size: int) -> tuple[int, int] | None:
    """(row, column); None is a pass."""
    if not value or (value == "tt" and size <= 19):
        return None
    return ord(value[1]) - 97, ord(value[0]) - 97


def parse_record(text: str, board_size: int = 19, first: int = 0, last: int | None = None, boards_kept: int = 8) -> tuple[dict, list[dict]]:
    """(info, positions) of a record. Positions are snapshots before each move of the main line numbered first .. last - 1; an illegal move ends the game. A board of another size raises ValueError; missing setup stones count as none. boards_kept: how many boards a position has, its own and those before it; of none it has null."""
    nodes = _nodes(text)
    if not nodes:
        raise ValueError("no record")
    root = nodes[0]
    one = lambda k, other: (root.get(k) or [other])[0]
    size = int(one("SZ", "19").split(":")[0])
    if size != board_size:
        raise ValueError(f"board of {size}, not {board_size}")
    board = np.zeros((size, size), np.int64)
    for k, stone in (("AB", 1), ("AW", 2)):
        for v in root.get(k, []):
            if p := _point(v, size):
                board[p] = stone
    history: list[np.ndarray] = []
    out, n = [], 0
    for node in nodes:
        for k, stone in (("B", 1), ("W", 2)):
            for v in node.get(k, []):
                p = _point(v, size)
                if first <= n and (last is None or n < last):
                    out.append({"move_number": n, "board": board.ravel().tolist() if boards_kept else None, "history": [h.ravel().tolist() for h in history[: boards_kept - 1]] if boards_kept else None, "next_row": p[0] if p else None, "next_col": p[1] if p else None, "next_color": stone})
                new = board.copy() if p is None else boards.play(board, *p, stone)
                if new is None:
                    break
                history, board, n = [board, *history[:7]], new, n + 1
            else:
                continue
            break
        else:
            continue
        break
    info = {"black": one("PB", "Unknown"), "white": one("PW", "Unknown"), "result": one("RE", "Unknown"), "board_size": size, "komi": float(one("KM", "7.5") or 7.5), "handicap": int(one("HA", "0") or 0), "n_moves": n, "n_encoded": len(out)}
    return info, out


POSITIONS = "filename string, move_number int, board array<int>, history array<array<int>>, next_row int, next_col int, next_color int, result string, error string"


def write_records(records: DataFrame, folder: str) -> None:
    """One *.sgf file below folder for each record (filename, value); the last of a name stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for name, text in zip(b["filename"], b["value"], strict=True):
                with fs.open_output_stream(f"{base}/{name}.sgf") as f:
                    f.write((text or "").encode())
            yield b[["filename"]]

    records.select("filename", "value").mapInPandas(run, "filename string").write.format("noop").mode("overwrite").save()


def read_records(spark: SparkSession, folder: str, board_size: int = 19, max_games: int | None = None, positions_per_game: int | None = None, first: int = 0, last: int | None = None, boards_kept: int = 8) -> DataFrame:
    """Positions of the *.sgf files below a folder: of the first max_games by name, and as positions_of. A file that can't be parsed gives one row with its error."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sgf").text(folder).select(F.input_file_name().alias("filename"), "value")
    return positions_of(files.orderBy("filename").limit(max_games) if max_games is not None else files, board_size, first, last, positions_per_game, boards_kept)


def counters(positions: DataFrame) -> DataFrame:
    """(games, skipped, positions) of what positions_of gives: records with a position or none to keep, records that couldn't be parsed, and positions."""
    bad = F.col("error").isNotNull()
    return positions.agg(F.count_distinct(F.when(~bad, F.col("filename"))).alias("games"), F.count_distinct(F.when(bad, F.col("filename"))).alias("skipped"), F.count("move_number").alias("positions"))


def positions_of(records: DataFrame, board_size: int = 19, first: int = 0, last: int | None = None, per_game: int | None = None, boards_kept: int = 8) -> DataFrame:
    """Positions of records (filename, value) before moves first .. last - 1, of a game with more than per_game of them only those floor(k (n - 1) / (per_game - 1)). boards_kept: as in parse_record; columns that aren't read cost less so."""

    most = max(1, BATCH_POSITIONS // (1 + 16 * max(boards_kept, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in POSITIONS.split(", ")]
        none = dict.fromkeys(names)
        table = lambda made: pd.DataFrame(made, columns=names, dtype=object).astype({c: "Int32" for c in ("move_number", "next_row", "next_col", "next_color")})
        made = []
        for b in batches:
            for name, text in zip(b["filename"], b["value"], strict=True):
                try:
                    info, rows = parse_record(text or "", board_size, first, last, boards_kept)
                    if per_game is not None and len(rows) > per_game:
                        rows = [rows[k * (len(rows) - 1) // max(per_game - 1, 1)] for k in range(per_game)]
                    made += [none | {"filename": name, **r, "result": info["result"]} for r in rows]
                except (ValueError, IndexError, TypeError) as e:
                    made.append(none | {"filename": name, "error": str(e)})
                # a table of many records: one of each record costs more than its parsing
                if len(made) >= most:
                    yield table(made)
                    made = []
        if made:
            yield table(made)

    return records.select("filename", "value").mapInPandas(run, POSITIONS)


def split_records(lines: DataFrame) -> DataFrame:
    """(file, record, value) of concatenated records from lines (file, line, value): a record ends where the depth of parentheses is zero again; only those that begin with (;GM[1] stay. The depth is a running sum by file."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line")
    step = F.length(F.regexp_replace("value", r"[^(]", "")) - F.length(F.regexp_replace("value", r"[^)]", ""))
    x = lines.withColumn("depth", F.sum(step).over(w)).withColumn("before", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    x = x.withColumn("record", F.sum(((F.col("before") == 0) & F.col("value").startswith("(")).cast("int")).over(w)).where("before > 0 or depth > 0 or value like '(%'")
    g = x.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda s: s["value"]), "\n").alias("value"))
    return g.where(F.col("value").startswith("(;GM[1]"))


def text_moves(records: DataFrame, col: str = "value", least: int = 50) -> DataFrame:
    """records with result, date and moves, read by patterns alone; records of fewer moves than least go."""
    moves = F.filter(F.regexp_extract_all(col, F.lit(r";[BW]\[([a-z]*)\]"), F.lit(1)), lambda m: F.length(m) == 2)
    x = records.withColumn("result", F.regexp_extract(col, r"RE\[([^\]]*)\]", 1)).withColumn("date", F.regexp_extract(col, r"DT\[([^\]]*)\]", 1)).withColumn("moves", moves)
    return x.where(F.size("moves") >= least)
