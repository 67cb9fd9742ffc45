"""Operators 11 to 13 against brute force and on odd tables."""
import hashlib
import random
import re
import sys
import zlib
from itertools import permutations, product
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
import oracle_check  # noqa: E402

from precis.llm import conversation_repair as cr  # noqa: E402
from precis.llm import filter_audit, maxscore, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_filter_interaction_audit", "op13_exact_topk_search"])
def test_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    rel = oracle_check.duck_connect(SMALL).execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert oracle_check.digest(got.columns, [tuple(r) for r in got.collect()]) == oracle_check.digest(names, rel.fetchall())


# ---------------------------------------------------------------- 11
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def all_repairs(rows):
    """(cost, audit, lines) of the best edits, by trying every sequence of edits with up to two insertions in a place."""
    best, seen = None, set()
    faults = []
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    gaps = [p for m in range(3) for p in product("ua", repeat=m)]
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        late = 3 * (fault == "truncated")
        choices.append([("D", 4, None)] + ([] if fault in ("blank", "duplicate") else
                       [("K", late, (role, text)), ("R", 3 + late, ("user", text)), ("R", 3 + late, ("assistant", text))]))
    for edits in product(*choices):
        for ins in product(gaps, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 3 * sum(map(len, ins))
            if best is not None and cost > best[0]:
                continue
            audit, out = "", []
            for i, added in enumerate(ins):
                audit += "I" * len(added)
                out += [({"u": "user", "a": "assistant"}[a], "") for a in added]
                if i < len(rows):
                    audit += edits[i][0]
                    out += [edits[i][2]] if edits[i][2] else []
            if LEGAL.match("".join(r[:1] or "?" for r, _ in out)):
                found = (cost, audit, [f"{r}:{t}" for r, t in out])
                best = found if best is None else min(best, found)
    return best, faults


def test_repair_equals_all_edits(spark):
    rnd = random.Random(11)
    convs = {}
    for c in range(70):
        convs[c] = [(rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]),
                     rnd.choice(["Yes.", "No", "Why?", "", "So", " \t", f"n{rnd.random()}!"])) for _ in range(rnd.randint(1, 4))]
    data = [(c, t, r, x, False) for c, rows in convs.items() for t, (r, x) in enumerate(rows)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, absent boolean")
    got = {r["conv_id"]: r for r in cr.digests(cr.repairs(df)).collect()}
    for c, rows in convs.items():
        (cost, audit, lines), faults = all_repairs(rows)
        r = got[c]
        assert (r["cost"], r["audit"]) == (cost, audit), (rows, r)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert [r["blank"], r["duplicate"], r["truncated"]] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]


def test_path_equals_full_table():
    """The tree against a table of complete strings, on long random rows, with few edits held."""
    rnd = random.Random(5)
    for _ in range(150):
        rows = [(rnd.choice("suau"), rnd.choice([None, None, None, "truncated", "blank"])) for _ in range(rnd.randint(0, 60))]
        tree, out, most = cr.Survivors(), b"", 0
        table = {cr.START: (0, b"")}
        for initial, fault in rows:
            out += tree.step(initial, fault)
            most = max(most, tree.unresolved())
            new = {}
            for target, ways in enumerate(cr._MOVES[initial, fault == "truncated", fault == "blank"]):
                for source, edits, price in ways:
                    if source in table:
                        w = (table[source][0] + price, table[source][1] + edits)
                        new[target] = min(new.get(target, w), w)
            table = new
        want = min((c + 3 * len(cr._ENDING[q]), s + cr._ENDING[q]) for q, (c, s) in table.items())
        assert out + tree.finish() == want[1]


def test_few_edits_are_held():
    """100,000 turns, deleted, kept and damaged ones mixed: only the last few edits are unresolved at any time."""
    rnd = random.Random(6)
    tree, most = cr.Survivors(), 0
    for i in range(100_000):
        tree.step("ua"[i % 2] if rnd.random() < 0.9 else rnd.choice("sua"), rnd.choice([None] * 6 + ["truncated", "blank"]))
        most = max(most, tree.unresolved())
    assert most < 300


def test_undecided_phase_is_linear():
    """User rows only: two phases stay as dear, nothing is settled, and the edits are held in two strings."""
    tree = cr.Survivors()
    out = b"".join(tree.step("u", None) for _ in range(30_000))
    assert tree.unresolved() < 3 * 30_000
    assert out + tree.finish() == b"KR" * 15_000


def test_repair_odd(spark):
    schema = "conv_id long, turn long, role string, text string, absent boolean, cost string, edit string"
    rows = [(1, None, None, None, False, "x", "y"), (1, 3, "user", "Hi.", False, "x", "y"), (1, 3, "user", "Hi.", False, "x", "y"),
            (None, None, "user", "A.", False, "x", "y"), (None, None, "assistant", "B. " + "long " * 200_000 + ".", False, "x", "y"),
            (2, 0, "user", "gone", True, "x", "y"), (3, 5, "", "?", False, "x", "y"), (4, -2 ** 63, "user", "a.", False, "x", "y"),
            (4, 2 ** 63 - 1, "assistant", "b.", False, "x", "y")]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in cr.digests(cr.repairs(df)).collect()}
    assert set(got) == {1, None, 2, 3, 4}
    assert (got[1]["audit"], got[1]["blank"], got[1]["duplicate"], got[1]["gaps"]) == ("DKDI", 1, 1, 0)
    assert (got[None]["audit"], got[None]["gaps"], got[None]["illegal"]) == ("RR", 0, 0) or got[None]["cost"] > 0
    assert (got[2]["audit"], got[2]["cost"], got[2]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert got[3]["audit"] == "D"
    assert got[4]["audit"] == "KK" and got[4]["gaps"] == 2 ** 63 - 1
    none = spark.createDataFrame([], schema)
    assert cr.digests(cr.repairs(none)).collect() == [] and cr.digests(cr.repairs(cr.damaged(none))).collect() == []
    kept = [r for r in cr.repairs(df).where("conv_id = 1").collect()]
    assert [(r["edit"], r["role"], r["text"]) for r in sorted(kept, key=lambda r: r["n"])] == [
        ("D", None, None), ("K", "user", "Hi."), ("D", None, None), ("I", "assistant", "")]


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {t}?") for c in range(30) for t in range(10)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in cr.damaged(df).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["absent"]))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = [("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, kind == 0)]
        assert got[c, t] == want * (2 if kind == 3 else 1)


# ---------------------------------------------------------------- 12
def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    failed = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = {"A"} if len(w) < 200 else set()
        s |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        s |= {"C"} if 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) > 3 * len(t) else set()
        s |= {"D"} if re.search("[#$%&*|]", t) else set()
        s |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        failed.append((lang or "", s, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        shap = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [f for f in failed if f[0] == part]
            for step, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shap[x] += len(gone)
                every = [f for f in failed if f[0] == part and x in f[1]]
                out[part, "".join(order), step + 1] = [len(left), len(gone), len(every) - len(gone), sum(f[1] == {x} for f in every),
                                                       sum(f[2] for f in gone), sum(f[3] for f in gone), x]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shap[v[6]] if isinstance(v[6], str) else v[6]
    return out


def test_audit_equals_brute_force(spark):
    rnd = random.Random(12)
    long = " ".join(f"w{i}" for i in range(230))
    pool = ["", None, "few words", "MANY CAPITALS", "a $ b", long, long + " #", "x " * 300, long.upper(), "naïve   日本" * 80, long + "\x0b\x85 end"]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(pool), rnd.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(1, "twice", "en"), (1, "twice", "de"), (2, "twice", "en"), (100, "L " * 300_000, "en"), (101, "L " * 300_000, "en")]
    labels = [(rnd.randrange(60), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    d = spark.createDataFrame([(*r, "clash", 7) for r in docs], "doc_id long, text string, lang string, h string, bits int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(d, lab).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).collect() == []
    assert len(filter_audit.audit(d, lab.limit(0)).collect()) == 600 * 3


# ---------------------------------------------------------------- 13
def brute_top(rows, k, every):
    from math import floor
    ok = [(i, tuple(floor(1024 * e) if abs(e) < 2 ** 43 else int(e) * 1024 for e in x)) for i, x in rows
          if i is not None and x is not None and all(e is not None and abs(e) < float("inf") for e in x)]
    out = []
    for i, q in sorted(set(ok)):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in ok if j != i)[:k]
            out += [(i, r + 1, j, max(min(-v, 2 ** 63 - 1), -2 ** 63)) for r, (v, j) in enumerate(s)]
    return sorted(out)


def check_top(spark, rows, k=10, every=5):
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(tuple(r) for r in maxscore.search(df, k, every).collect()) == brute_top(rows, k, every)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(rng.normal(size=(300, 8)) * 0.02)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400 + i, [0.0] * 8) for i in range(15)] + [(-5, [-0.001] * 8)]
    check_top(spark, rows)


def test_topk_odd(spark):
    rows = [(0, [1.0, -2.0]), (0, [1.0, -2.0]), (5, None), (10, [float("nan"), 1.0]), (15, [None, 1.0]), (20, [float("inf"), 0.0]), (None, [1.0, 1.0]),
            (25, []), (1, [3.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [0.00001, -0.00001])]
    check_top(spark, rows)
    check_top(spark, rows[:1])
    check_top(spark, [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [2e300, 0.5]), (4, [1e13, 3.0]), (5, [-2e300, 0.5])])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.search(empty).collect() == []


def test_pruned_rows_do_not_compete():
    """Skewed weights: most rows are never probed, and the result is that of all products."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(20_000, 30)) * 1024 * np.where(rng.random((20_000, 30)) < 0.1, 1.0, 0.0))
    ids = rng.permutation(20_000)
    shard = maxscore.Shard(x, ids)
    for i in range(20):
        q = np.where(rng.random(30) < 0.4, np.floor(1024 * rng.normal(size=30)), 0.0)
        rows, s = shard.top(q, 11)
        want = np.lexsort((ids, -(x @ q)))[:11]
        assert rows.tolist() == want.tolist() and s.tolist() == (x @ q)[want].tolist()
