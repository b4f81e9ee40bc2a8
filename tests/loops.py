"""Order-dependent choices over small tables, one row at a time."""


def first_kept(order, likes):
    """Every row of ``order`` with the kept row it points at, or None if it is kept.

    ``likes[new, old]`` is how well a row fits an earlier one; pairs that do not match are absent. The
    best kept row wins, the earliest of equals.
    """
    kept, out = [], {}
    for new in order:
        options = [(likes[new, old], -place, old) for place, old in enumerate(kept)
                   if (new, old) in likes]
        out[new] = max(options)[2] if options else None
        if not options:
            kept.append(new)
    return out


def deal_loop(rows, days=14):
    """rows in order: (id, firm, company, seconds or None) -> ids shown."""
    kept = []
    for r in rows:
        def same(k):
            if r[1] != k[1] or not r[2] or not k[2]:
                return False
            if r[2].strip().lower() != k[2].strip().lower():
                return False
            return r[3] is None or k[3] is None or abs(r[3] - k[3]) <= days * 86400
        if not any(same(k) for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def added_loop(rows, known, days=14):
    """rows by id: (id, company, stage, seconds or None); known: the same without id."""
    kept = list(known)
    ids = set()
    for rid, company, stage, t in rows:
        if company is None:
            continue
        hit = any(c.lower() == company.strip().lower() and s == stage
                  and (t is None or (kt is not None and abs(kt - t) <= days * 86400))
                  for c, s, kt in kept)
        if not hit:
            ids.add(rid)
            kept.append((company, stage, t))
    return ids
