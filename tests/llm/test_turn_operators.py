"""Operators on conversations and lines against plain evaluations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalrates.llm import linededup, prefix_trie, repair
from vitalrates.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string"
#: columns whose names the operators use themselves
CLASH = {"conv": 1, "part": 2, "node": 3, "depth": 4, "place": 5, "there": 6, "kind": 7, "symbols": 8, "audit": 9, "n_lines": 10, "doc": 11}


SP="\x20\t\n\x0b\x0c\r"
def damage(rows):
    convs=defaultdict(list)
    for c,t,r,x in rows:
        convs[c]
        k=zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode())%20
        r=" " if r is None else r; x=" " if x is None else x
        tie=hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32]
        key=(t is not None, t or 0, r, tie)
        if k==0: continue
        if k==1: x=""
        if k==2: x=re.sub("[.!?]","",x)
        if k==4: r="user"
        for copy in range(2 if k==3 else 1): convs[c].append((key+(copy,),t,r,x))
    return {c:[y[1:] for y in sorted(v,key=lambda y:y[0])] for c,v in convs.items()}
NEXT={"s":{0:1},"u":{0:2,1:2,3:2},"a":{2:3}}
def solve(rows):
    """Best (cost, audit, output), comparing whole strings."""
    best={0:(0,"",())}
    def ins(best):
        best=dict(best)
        for _ in range(3):
            for q,(c,a,o) in list(best.items()):
                for r,name in (("u","user"),("a","assistant")):
                    if q in NEXT[r]:
                        n=(c+2,a+"I",o+((name,""),)); z=NEXT[r][q]
                        if z not in best or n[:2]<best[z][:2]: best[z]=n
        return best
    best=ins(best)
    for r,x,must,tr in rows:
        new={}
        def put(z,n):
            if z not in new or n[:2]<new[z][:2]: new[z]=n
        for q,(c,a,o) in best.items():
            put(q,(c+3,a+"D",o))
            if not must:
                if r[:1] in NEXT and q in NEXT[r[:1]]: put(NEXT[r[:1]][q],(c+tr,a+"K",o+((r,x),)))
                for i,name in (("u","user"),("a","assistant")):
                    if q in NEXT[i]: put(NEXT[i][q],(c+2+tr,a+"R",o+((name,x),)))
        best=ins(new)
    return min(best[q] for q in (0,3) if q in best)
def plain_repair(rows):
    out=[]
    for c,ts in damage(rows).items():
        n=dict(b=0,d=0,t=0); seen=set(); todo=[]; ill=0
        for i,(t,r,x) in enumerate(ts):
            y=x.rstrip(SP)
            f="b" if not y else "d" if (r,x) in seen else "" if y[-1] in ".!?" else "t"
            seen.add((r,x))
            if f: n[f]+=1
            todo.append((r,x,f in ("b","d"),int(f=="t")))
            if i and ts[i-1][1][:1]+r[:1] not in ("su","ua","au"): ill+=1
        tt=[t for t,_,_ in ts if t is not None]
        gaps=max(tt)-min(tt)+1-len(set(tt)) if tt else 0
        cost,a,o=solve(todo)
        out.append((c,gaps,n["b"],n["d"],n["t"],ill,cost,a,hashlib.sha256("\n".join(f"{r}:{x}" for r,x in o).encode()).hexdigest()))
    return out


def plain_trie(rows):
    convs=defaultdict(list)
    for c,t,r,x in rows:
        if c is None: continue
        r=r or ""; x=x or ""
        convs[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32], x))
    for c in convs: convs[c]=[(r,x) for _,_,r,_,x in sorted(convs[c])]
    built={}
    for c in convs:
        h=zlib.crc32(str(c).encode())%4
        s=c-int(math.fmod(c,20))
        built[c]=convs.get(s,[])[:h]+convs[c][h:]
    members=defaultdict(list); kids=defaultdict(set); ends=defaultdict(list)
    for c,p in built.items():
        for d in range(len(p)+1):
            members[tuple(p[:d])].append(c)
            if d: kids[tuple(p[:d-1])].add(tuple(p[:d]))
        ends[tuple(p)].append(c)
    out=[]
    def words(k): return len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    leaves={}; saved={}
    for k in sorted(members,key=len,reverse=True):
        leaves[k]=sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k]=(len(members[k])-1)*words(k)+sum(saved[x] for x in kids[k])
    for k,m in members.items():
        out.append((min(m),len(k),min(members[k[:-1]]) if k else None,len(m),len(kids[k]),leaves[k],saved[k],hashlib.sha256(",".join(map(str,sorted(ends[k]))).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    words = ["yes", "no", "why?", "fine.", "really", "a  b", "ok!", "\t", "Ünï 日本"]
    say = lambda n=4: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = []
    for c in range(140):
        for t in range(rng.choice([0, 1, 2, 4, 8])):
            rows.append((c, t, ["user", "assistant"][t % 2] if rng.random() < 0.85 else rng.choice(["system", "tool", "", None, "user"]),
                         "hello" if t < 2 and rng.random() < 0.6 else rng.choice([None, say(), say(), say(9)])))
    rows += [(200, None, "user", "first"), (200, 5, "user", "x."), (200, 5, "assistant", "tie"), (200, 5, "assistant", "tie"), (200, None, None, None)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"same {t}.") for c in range(300, 420) for t in range(6)]     # a hot conversation
    rows += [(500, t, rng.choice(["user", "assistant", "system"]), f"turn {t % 40}" + rng.choice(["", "."])) for t in range(700)]   # very long
    rows += [(501, 0, "user", "word " * 50_000), (-7, 0, "user", "minus"), (-7, 1, "assistant", "minus."), (None, 0, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def conversations(spark, talks):
    return spark.createDataFrame(talks, SCHEMA).repartition(3).withColumns({c: F.lit(v) for c, v in CLASH.items()})


# ------------------------------------------------------------------ repair
def test_repair_query_equals_a_search_over_whole_strings(conversations, talks):
    got = repair.repaired(conversations)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_repair(talks), key=str)


def test_rules_of_any_depth_give_the_same_audits():
    rng = random.Random(9)
    rules = ("ua", chr(0xE000) * 2, "ux", "SA", chr(0xE001) + "u", "aa")
    kinds = {"x": ("?", "", 1, 0)} | {s: (s if s != "o" else "t", s, 0, 0) for s in "suao"} | {s.upper(): (s if s != "o" else "t", s, 0, 1) for s in "suao"}
    for rule in ((), rules):
        g = repair.Grammar(rule)
        for _ in range(300):
            s = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(12)))
            assert g.solve(s) == solve([kinds[c] for c in s])[:2], s
        assert g.solve("ua" * 400) == (0, "K" * 800)


def test_ropes_compare_as_strings():
    rng = random.Random(1)
    for _ in range(300):
        parts = [[repair.join("K" * rng.randrange(90), rng.choice("DIK")) for _ in range(rng.randrange(1, 6))] for _ in range(2)]
        a, b = ("", "")
        for p in parts[0]:
            a = repair.join(a, p)
        for p in parts[1]:
            b = repair.join(b, p)
        assert repair.less(a, b) == (repair.flat(a) < repair.flat(b))
        assert not repair.less(a, a)


def test_repaired_turns_follow_the_pattern(spark, conversations):
    turns = repair.as_turns(conversations)
    out = repair.repaired_turns(repair.audited(turns), turns).collect()
    talk = defaultdict(list)
    for r in sorted(out, key=lambda r: r.pos):
        talk[r.conv].append(r.role[:1])
    assert talk and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in talk.values())
    assert [r.pos for r in sorted((r for r in out if r.conv == 500), key=lambda r: r.pos)] == list(range(len(talk[500])))


def test_rules_are_learnt_in_rounds(spark):
    strings = spark.createDataFrame([("ua" * 8, 5), ("x", 1), ("sua", 2)], "symbols string, n long")
    rules = repair.learn_rules(strings, rounds=4, each=1)
    assert rules[0] == "ua" and len(rules) == 4 and rules[1] == chr(0xE000) * 2
    assert len(repair.shortened("ua" * 8, rules)) == 1


# -------------------------------------------------------------------- trie
def test_trie_query_equals_sets_of_prefixes(conversations, talks):
    got = prefix_trie.prefix_nodes(conversations)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_trie(talks), key=str)


@pytest.mark.parametrize("crown", [1, 5, 10_000])
def test_trie_does_not_depend_on_where_it_is_cut(conversations, talks, crown):
    own = stored(prefix_trie.paths(*prefix_trie.borrowed(conversations)), "test-paths")
    got = [(r.conv, r.depth, r.parent_conv, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in prefix_trie.trie(own, crown=crown).collect()]
    assert sorted(got, key=str) == sorted((x[:7] for x in plain_trie(talks)), key=str)


def test_ends_of_many_ranges_join_in_order(conversations, talks):
    own = stored(prefix_trie.paths(*prefix_trie.borrowed(conversations)), "test-paths")
    few, many = ({(bytes(r.node), r.ends_sha256) for r in prefix_trie.end_digests(own, bits).collect()} for bits in (16, 2))
    assert few == many and len(few) > 50


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        slots = prefix_trie.Slots(keys)
        assert sorted(slots(keys).tolist()) == list(range(n))
        assert (slots(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.ones((2, 2), np.uint64))


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repaired(none).count() == 0 and prefix_trie.prefix_nodes(none).count() == 0


# ------------------------------------------------------------------- lines
def plain_lines(rows, least=20, copies=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SP))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    top = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v - {None}) >= copies}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if top.get(key(x), i) == i]
        out.append((i, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return out


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(8)
    pool = [f"  Line {k} of some LICENCE text {k * k}\t" for k in range(60)] + [f"É short {k}" for k in range(9)] + ["ÉÀ the line beyond ascii Z", "x" * 19, "y" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(80)]
    rows += [(i, pool[7].upper().replace("\t", "") + "\n") for i in range(100, 160)]          # a hot line
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, pool[0]), (None, pool[0] + "\n" + pool[1]), rows[3], rows[3], (5, pool[3] + "\nanother text of id 5, long enough")]
    rows += [(170, "\n".join(pool[k % 60] for k in range(30_000)))]                            # very long
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches, fanout, hot", [(1, 2, 10_000), (4, 2, 10_000), (5, 3, 1), (4, 2, 30)])
def test_lines_equal_a_plain_evaluation(spark, line_rows, batches, fanout, hot):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(v) for c, v in CLASH.items()})
    out = linededup.deduplicated(docs, batches=batches, fanout=fanout, hot=hot)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"} and out.first().conv == 1
    got = out.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(line_rows))
    assert out.where("text IS NULL").count() == 1


def test_runs_level_up_and_skip_settled_keys(spark, line_rows):
    keys = linededup.line_keys(spark.createDataFrame(line_rows, "doc_id long, text string")).cache()
    runs = linededup.LineRuns(spark, fanout=2, buckets=4)
    for i in range(3, -1, -1):
        runs.add(keys.where((F.col("doc") >= 45 * i) & (F.col("doc") < 45 * (i + 1))))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    whole = linededup.LineRuns(spark, buckets=4)
    whole.add(keys)
    frequent = lambda r: {(x.h1, x.h2, x.top) for x in r.frequent().collect()}
    assert frequent(runs) == frequent(whole)
    again = runs.unsettled(keys.where("doc < 45"))
    settled = {(x.h1, x.h2) for x in runs.frequent().collect()}
    assert settled.isdisjoint({(x.h1, x.h2) for x in again.collect()})


def test_runs_are_merged_without_moving_them(spark, line_rows):
    """Joins of runs read their buckets: only the batch itself is dealt."""
    keys = linededup.line_keys(spark.createDataFrame(line_rows, "doc_id long, text string"))
    runs = linededup.LineRuns(spark, fanout=9)
    runs.add(keys.where("doc >= 80"))
    runs.add(keys.where("doc >= 40 AND doc < 80"))
    plan = runs.merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Python" not in plan


def test_no_documents_no_lines(spark):
    assert linededup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
