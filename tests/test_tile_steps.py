import sys

import pandas as pd

from kerbside.operators.tiles import _tile_components


def test_tile_components_of_a_full_tile_take_array_steps():
    # a comb: full rows of every second column, joined at one end, and a cell apart
    on = [(i, j) for i in range(32) for j in range(32) if (j % 2 == 0 or i == 0) and (i, j) != (31, 30) and j != 29] + [(31, 31)]
    pdf = pd.DataFrame({"ci": [i + 7 for i, _ in on], "cj": [j - 3 for _, j in on], "node": [(k * 7919) % 100003 for k in range(len(on))]})
    want, seen = {}, set()
    where = {c: int(n) for c, n in zip(on, pdf["node"])}
    for c in on:
        if c in seen:
            continue
        part, todo = [], [c]
        seen.add(c)
        while todo:
            i, j = todo.pop()
            part.append((i, j))
            for o in [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if o in where and o not in seen:
                    seen.add(o)
                    todo.append(o)
        want.update({where[x]: min(where[y] for y in part) for x in part})
    out = _tile_components(pdf)
    assert dict(zip(out["node"].tolist(), out["local"].tolist())) == want
    full = pd.DataFrame([(i, j, (i * 32 + j) * 31 % 1031) for i in range(32) for j in range(32)], columns=["ci", "cj", "node"])
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = _tile_components(full)
    finally:
        sys.setprofile(None)
    assert set(out["local"]) == {int(full["node"].min())}
    assert calls[0] < 4 * len(full)  # no calls per cell and neighbour
