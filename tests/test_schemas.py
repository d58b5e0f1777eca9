import json
import random

import pytest

from papyra.operators import schemas as sc


def _number(v):
    """A whole number as a lax reader takes it, or None."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return int(v) if v == int(v) else None
    if isinstance(v, str):
        try:
            return int(v)
        except ValueError:
            try:
                return int(float(v)) if float(v) == int(float(v)) and set(v.split(".")[1]) <= {"0"} else None
            except (ValueError, IndexError):
                return None
    return None


def _brute(record, kind):
    if not isinstance(record, dict):
        return None, ["not an object"]
    out, wrong = {}, []
    for f in sc.SCHEMAS[kind]:
        *path, last = f.name.split(".")
        holder = record
        for p in path:
            holder = holder.get(p) if isinstance(holder, dict) else None
        if path and not isinstance(holder, dict):
            continue
        default = None if f.default is sc.REQUIRED else list(f.default or ()) if f.kind == "texts" else f.default
        value, why = default, None
        if last not in holder:
            why = "missing" if f.default is sc.REQUIRED else None
        else:
            v = holder[last]
            good = {"text": isinstance(v, str), "number": _number(v) is not None, "texts": isinstance(v, list) and all(isinstance(x, str) for x in v), "object": isinstance(v, dict)}[f.kind]
            if v is None:
                why = None if f.default is None else {"text": "not a text", "number": "not a whole number", "texts": "not a list of texts", "object": "not an object"}[f.kind]
            elif not good:
                why = {"text": "not a text", "number": "not a whole number", "texts": "not a list of texts", "object": "not an object"}[f.kind]
            else:
                value = _number(v) if f.kind == "number" else v
                if f.filled and value == "":
                    why = "empty"
                elif f.least is not None and value < f.least:
                    why = f"below {f.least}"
                elif f.most is not None and value > f.most:
                    why = f"above {f.most}"
                elif f.words and value not in f.words:
                    why = "unknown value"
        if why:
            wrong.append(f"{f.name}: {why}")
        if not path:
            out[f.name] = value
    return out, wrong


def _random(g, kind):
    record: dict = {}
    for f in sc.SCHEMAS[kind]:
        if g.random() < 0.3:
            continue
        good = {"text": lambda f=f: g.choice(f.words or ("x", "长", "")), "number": lambda f=f: g.randrange(f.least or 0, (f.most or 9) + 1), "texts": lambda: [g.choice("ab") for _ in range(g.randrange(3))], "object": dict}[f.kind]
        odd = g.choice([None, "", "odd", 0, -1, 7, 2000, 2.0, 2.5, True, "2", "2.0", "x2", [], ["a", 1], ["a", None], {}, {"k": 1}])
        *path, last = f.name.split(".")
        holder = record
        for p in path:
            holder = holder.setdefault(p, {}) if isinstance(holder, dict) else None
        if isinstance(holder, dict):
            holder[last] = good() if g.random() < 0.7 else odd
    return record


@pytest.mark.parametrize("kind", sorted(sc.SCHEMAS))
def test_each_rule_by_brute_force(spark, kind):
    g = random.Random(kind)
    records = [_random(g, kind) for _ in range(150)] + [{}, [], "text", 5, None]
    rows = [(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)] + [(900, "not json"), (901, None), (902, "")]
    got = {r.i: r for r in sc.checked(spark.createDataFrame(rows, "i long, json string"), kind).collect()}
    assert len(got) == len(rows)
    for i, record in enumerate(records):
        want, wrong = _brute(record, kind)
        assert got[i].violations == wrong, record
        if want is None:
            assert got[i].record is None
            continue
        mine = got[i].record.asDict()
        if "attributes" in mine:
            mine["attributes"], want["attributes"] = json.loads(mine["attributes"]), want["attributes"] if isinstance(want["attributes"], dict) else {}
        assert mine == want, record
    assert all(got[i].violations == ["not an object"] and got[i].record is None for i in (900, 901, 902))
