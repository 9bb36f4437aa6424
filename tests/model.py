"""A plain, one-row-at-a-time reading of the name rules, for small inputs."""

from collections import Counter
from itertools import groupby

SOUNDS = {c: str(d) for d, cs in enumerate(["BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"], 1) for c in cs}


def sound(name):
    letters = [c for c in name.upper() if "A" <= c <= "Z"]
    if not letters:
        return "0000"
    classes = [SOUNDS.get(c, c) for c in letters]
    heard = []
    while classes:
        c = classes[0]
        # A class swallows its repeats, one stretch of H and W, and repeats after that.
        for swallowed in ([c] if c.isdigit() else [], ["H", "W"], [c] if c.isdigit() else []):
            while classes and classes[0] in swallowed:
                classes.pop(0)
        if c.isdigit():
            heard.append(c)
        elif c not in "HW":
            heard.append(classes.pop(0) if classes and classes[0] == c else c)
    head = letters[0]
    if heard and heard[0] == SOUNDS.get(head, head):
        heard = heard[1:]
    return (head + "".join(c for c in heard if c.isdigit()) + "000")[:4]


def near(a, b):
    """At most one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def alike(a, b):
    x, y = a.upper(), b.upper()
    return (
        sound(a) == sound(b) or near(x, y) or x.startswith(y) or y.startswith(x) or x.endswith(y) or y.endswith(x)
    )


def used_sets(names):
    """name -> (owner, set) over names in order of first appearance."""
    order = [n for n in dict.fromkeys(names) if n is not None and n.strip()]
    sets = sorted(((n, frozenset(m for m in order if alike(n, m))) for n in order), key=lambda s: len(s[1]))
    kept = [s for i, s in enumerate(sets) if not any(s[1] <= later[1] for later in sets[i + 1:])]
    return {n: next(s for s in kept if n in s[1]) for n in order}


def respell(rows):
    """Names after the misspelling rule, for (first, last) rows in order."""
    first_sets, last_sets = used_sets([r[0] for r in rows]), used_sets([r[1] for r in rows])

    def fold(sets, name):
        return {m.upper() for m in sets[name][1]} if name in sets else {name.upper()}

    out, left = list(rows), [i for i, r in enumerate(rows) if None not in r]
    while left:
        head = rows[left[0]]
        firsts, lasts = fold(first_sets, head[0]), fold(last_sets, head[1])
        group = [i for i in left if rows[i][0].upper() in firsts and rows[i][1].upper() in lasts]
        # Counter keeps the order of first appearance among equals.
        name = tuple(Counter(rows[i][part] for i in group).most_common(1)[0][0] for part in (0, 1))
        for i in group:
            out[i] = name
        left = [i for i in left if i not in set(group)]
    return out
