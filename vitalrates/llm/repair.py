"""Conversation repair by a grammar-compressed dynamic program.

A turn matters to the repair only by a symbol: its role's initial and whether
it must go (blank, duplicate) or ends too early. Conversations become strings
of symbols, and Re-Pair names frequent pairs: each round Spark counts the
adjacent pairs of all distinct strings, the most frequent get new symbols, and
the next round counts the shortened strings. A symbol stands for a min-plus
transfer matrix over the states of the wanted role pattern ``(s?(ua)+)?``:
per pair of states the least cost and, of equal ones, the ASCII-least audit.
The matrix of a rule is the product of its two symbols' matrices, worked out
once, bottom-up; audits are ropes that share the parts of their rules. A
conversation is a vector passed through the matrices of its few symbols, and
equal strings are worked out once per task.

The audit lists the edits in order: Keep (cost 0), Rerole (2), Delete (3),
Insert (2); a truncated turn that stays adds 1. Two audits of equal cost over
the same turns never begin one another (an insertion more costs more), so the
ASCII-least whole is made of ASCII-least parts and the matrices are exact.

Turns stream through tasks sorted by conversation; of a turn only digests and
flags are held, its text is read again when the audit is applied.

Defined cases: null role, text, turn or id are one space; rows without id are
one conversation; turns of one number are ordered by role, then by a digest,
copies are kept; a role without initial cannot be kept; a conversation without
turns has an empty audit; very long texts and conversations stream; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import map_batches, stored
from vitalrates.llm.linededup import SPACES
from vitalrates.llm.prefix_trie import turn_digest

# ------------------------------------------------------------------- ropes
FLAT = 64


class Rope:
    """A long string as two parts; parts are shared, never changed."""
    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, length(left) + length(right)


def length(r) -> int:
    return len(r) if isinstance(r, str) else r.size


def join(a, b):
    if not length(a):
        return b
    if not length(b):
        return a
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= FLAT else Rope(a, b)


def flat(r) -> str:
    out, todo = [], [r]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += [r.right, r.left]
    return "".join(out)


def less(a, b) -> bool:
    """Is rope a before rope b? Parts that are the same object are skipped."""
    a, b = [a], [b]
    while a and b:
        x, y = a.pop(), b.pop()
        if x is y:
            continue
        if not isinstance(x, str) and (isinstance(y, str) or x.size >= y.size):
            a += [x.right, x.left]
            b.append(y)
        elif not isinstance(y, str):
            b += [y.right, y.left]
            a.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if x[n:]:
                a.append(x[n:])
            if y[n:]:
                b.append(y[n:])
    return any(length(x) for x in b) and not any(length(x) for x in a)


# ---------------------------------------------------------------- matrices
START, SYSTEM, USER, DONE = range(4)      # nothing yet, after s, after u, after a whole pair
STATES = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, DONE: USER}, "a": {USER: DONE}}
GONE = "x"                                 # a turn that must be deleted


def better(new, old) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1]))


def times(a: list, b: list) -> list:
    """Min-plus product; an entry is (cost, audit) or None."""
    out = [[None] * 4 for _ in range(len(a))]
    for i, row in enumerate(a):
        for k in STATES:
            if row[k] is not None:
                for j in STATES:
                    if b[k][j] is not None:
                        new = row[k][0] + b[k][j][0], join(row[k][1], b[k][j][1])
                        if better(new, out[i][j]):
                            out[i][j] = new
    return out


def inserts() -> list:
    """Turns inserted in one place: at most one round of the pattern pays."""
    one = [[(0, "") if i == j else None for j in STATES] for i in STATES]
    step = [[(2, "I") if j in (NEXT["u"].get(i), NEXT["a"].get(i)) else None for j in STATES] for i in STATES]
    out, power = [r[:] for r in one], one
    for _ in range(3):
        power = times(power, step)
        for i in STATES:
            for j in STATES:
                if power[i][j] is not None and better(power[i][j], out[i][j]):
                    out[i][j] = power[i][j]
    return out


INSERTS = inserts()


def matrix(symbol: str) -> list:
    """Insertions, then what may become of one turn: small letters are whole
    turns, capitals truncated ones; o has another role."""
    m = [[(3, "D") if i == j else None for j in STATES] for i in STATES]
    if symbol != GONE:
        more, role = int(symbol.isupper()), symbol.lower()
        edits = [(more, "K", NEXT.get(role, {})), (2 + more, "R", NEXT["u"]), (2 + more, "R", NEXT["a"])]
        for cost, name, to in edits:
            for i, j in to.items():
                if better((cost, name), m[i][j]):
                    m[i][j] = (cost, name)
    return times(INSERTS, m)


FIRST_RULE = 0xE000        # rules are characters of the private use area


def shortened(symbols: str, rules: tuple[str, ...]) -> str:
    for i, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(FIRST_RULE + i))
    return symbols


class Grammar:
    """Rules (pairs of symbols) and their matrices, evaluated bottom-up."""

    def __init__(self, rules: tuple[str, ...]):
        self.rules = rules
        self.matrices = {s: matrix(s) for s in "suaoSUAO" + GONE}
        for i, pair in enumerate(rules):
            self.matrices[chr(FIRST_RULE + i)] = times(self.matrices[pair[0]], self.matrices[pair[1]])
        self.solved: dict[str, tuple[int, str]] = {}

    def solve(self, symbols: str) -> tuple[int, str]:
        """Least cost and its audit."""
        if symbols not in self.solved:
            v = [[(0, ""), None, None, None]]
            for s in shortened(symbols, self.rules):
                v = times(v, self.matrices[s])
            v = times(v, INSERTS)[0]
            best = v[DONE] if v[START] is None or better(v[DONE], v[START]) else v[START]
            if len(self.solved) >= 100_000:
                self.solved.clear()
            self.solved[symbols] = best[0], flat(best[1])
        return self.solved[symbols]


@lru_cache(maxsize=4)
def grammar(rules: tuple[str, ...]) -> Grammar:
    """One evaluation per worker process."""
    return Grammar(rules)


def learn_rules(strings: DataFrame, rounds: int = 10, each: int = 24) -> tuple[str, ...]:
    """Re-Pair over all strings (``symbols``, ``n`` conversations): a round
    counts the pairs in the strings as shortened so far and names the ``each``
    most frequent. At most rounds * each rules reach the driver."""
    rules: tuple[str, ...] = ()
    for _ in range(rounds):
        known = rules

        def run(batches, known=known):
            seen: dict[str, int] = {}
            for b in batches:
                for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s = shortened(s, known)
                    for i in range(len(s) - 1):
                        seen[s[i:i + 2]] = seen.get(s[i:i + 2], 0) + n
            if seen:      # at most (symbols + rules) squared
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                                 names=["pair", "n"])

        pairs = map_batches(strings.select("symbols", "n"), run, "pair string, n long")
        top = (pairs.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(each)).collect()
        if not top:
            break
        rules += tuple(r.pair for r in top)
    return rules


# ---------------------------------------------------------------- streaming
def judged(turns: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults and the string of symbols. ``turns``:
    ``conv, turn, role, text``, ``place`` (ties) and ``there`` (false: only
    names its conversation)."""
    text, there = F.col("text"), F.col("there")
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    fault = F.when(last == "", "b").when(last.isin(".", "!", "?"), "").otherwise("t")
    rows = turns.select("conv", "there", "turn", "place", F.when(there, F.substring("role", 1, 1)).alias("initial"),
                        F.when(there, fault).alias("fault"), F.when(there, turn_digest(F.col("role"), text)).alias("digest"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "place")
    kind = turns.schema["conv"].dataType
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "symbols"]
    from pyspark.sql.pandas.types import to_arrow_type
    own = to_arrow_type(kind)
    types = [own, *[pa.int64()] * 5, pa.string()]

    def run(batches):
        now, done = None, []

        def close():
            turn, n = now["turns"], now["n"]
            gaps = turn[1] - turn[0] + 1 - turn[2] if turn else 0
            done.append((now["conv"], gaps, n["b"], n["d"], n["t"], now["illegal"], "".join(now["symbols"])))

        for b in batches:
            for conv, there, turn, _, initial, fault, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        close()
                    now = {"conv": conv, "turns": None, "n": dict.fromkeys("bdt", 0), "illegal": 0, "symbols": [], "seen": set(), "before": None}
                if not there:
                    continue
                if turn is not None:
                    t = now["turns"]
                    now["turns"] = (t[0], turn, t[2] + (turn != t[1])) if t else (turn, turn, 1)
                if fault != "b" and digest in now["seen"]:
                    fault = "d"
                now["seen"].add(digest)
                if fault:
                    now["n"][fault] += 1
                if now["before"] is not None and now["before"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["before"] = initial
                role = initial if initial in ("s", "u", "a") else "o"
                now["symbols"].append(GONE if fault in ("b", "d") else role.upper() if fault == "t" else role)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), types)], names=names)
                done.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), types)], names=names)

    return map_batches(rows, run, f"conv {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string")


def audits(judgements: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Adds ``cost`` and ``audit`` to :func:`judged` conversations."""
    names = [*judgements.columns, "cost", "audit"]

    def run(batches):
        g = grammar(rules)
        for b in batches:
            got = [g.solve(s) for s in b.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())],
                                             names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in judgements.schema.fields)
    return map_batches(judgements, run, f"{kinds}, cost long, audit string")


def edited(audited: DataFrame, turns: DataFrame):
    """Audits and turns of each conversation side by side, as sorted rows: the
    audit first, then the turns it speaks of."""
    none = F.lit(None)
    heads = audited.select("conv", F.lit(0).alias("part"), none.cast("long").alias("turn"), none.cast(turns.schema["place"].dataType).alias("place"),
                           F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = heads.unionByName(turns.where("there").select("conv", F.lit(1).alias("part"), "turn", "place", "role", "text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "part", "turn", "place")


class Editor:
    """Applies one audit to a conversation's turns as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        self.state, role = (DONE, "assistant") if self.state == USER else (USER, "user")
        return role

    def inserted(self):
        """Roles of the turns inserted here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._made()

    def turn(self, role: str) -> str | None:
        """The role under which the turn stays; None: it goes."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[role[:1]][self.state]
        return None if edit == "D" else role if edit == "K" else self._made()


def repaired_turns(audited: DataFrame, turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv, pos, role, text``."""
    kind = audited.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        edit, now, pos = None, None, 0
        for b in batches:
            out = []
            for conv, part, _, _, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    out += [(now, pos + i, r, "") for i, r in enumerate(edit.inserted())] if edit else []
                    edit, now, pos = Editor(text), conv, 0
                    continue
                for r in edit.inserted():
                    out.append((now, pos, r, ""))
                    pos += 1
                if (r := edit.turn(role)) is not None:
                    out.append((now, pos, r, text))
                    pos += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), types)], names=["conv", "pos", "role", "text"])
        out = [(now, pos + i, r, "") for i, r in enumerate(edit.inserted())] if edit else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), types)], names=["conv", "pos", "role", "text"])

    return map_batches(edited(audited, turns), run, f"conv {kind.simpleString()}, pos long, role string, text string")


def repaired_digests(audited: DataFrame, turns: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` lines."""
    kind = audited.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(kind), pa.string()]

    def run(batches):
        edit, now, h, any_, done = None, None, None, False, []

        def add(line):
            nonlocal any_
            h.update(("\n" + line if any_ else line).encode())
            any_ = True

        def close():
            for r in edit.inserted():
                add(f"{r}:")
            done.append((now, h.hexdigest()))

        for b in batches:
            for conv, part, _, _, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    if edit:
                        close()
                    edit, now, h, any_ = Editor(text), conv, hashlib.sha256(), False
                    continue
                for r in edit.inserted():
                    add(f"{r}:")
                if (r := edit.turn(role)) is not None:
                    add(f"{r}:{text}")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), types)], names=["conv", "repaired_sha256"])
                done.clear()
        if edit:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), types)], names=["conv", "repaired_sha256"])

    return map_batches(edited(audited, turns), run, f"conv {kind.simpleString()}, repaired_sha256 string")


def audited(turns: DataFrame, **learn) -> DataFrame:
    """Stored judgements with least cost and audit, one row a conversation."""
    own = stored(judged(turns), "repair-judged")
    strings = stored(own.where("symbols <> ''").groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "repair-strings")
    return stored(audits(own, learn_rules(strings, **learn)), "repair-audits")


# ------------------------------------------------------------------- query
def as_turns(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation table as they are, for :func:`audited`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"),
                             space("text").alias("text"))
    return t.withColumns({"place": F.struct(F.col("role"), turn_digest(F.col("role"), F.col("text")), F.lit(0)), "there": F.lit(True)})


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage by crc32 of ``conv_id:turn`` modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    t = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"),
                             space("text").alias("text"), kind.alias("kind"))
    t = t.withColumn("digest", turn_digest(F.col("role"), F.col("text")))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    t = t.select("*", copies.alias("copy"))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .when(F.col("kind") != 0, F.col("text")))
    return t.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.struct("role", "digest", "copy").alias("place"), (F.col("kind") != 0).alias("there"))


def repaired(conversations: DataFrame) -> DataFrame:
    """Query view: every conversation after damage, its faults and repair."""
    turns = damaged(conversations)
    own = audited(turns)
    heads = own.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    done = repaired_digests(own, turns).select(F.col("conv").alias("c"), "repaired_sha256")
    return heads.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
