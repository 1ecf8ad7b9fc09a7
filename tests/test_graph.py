"""Index pages and block chains: rings, shared tails and random graphs against a search by hand."""

import random

from tracelake.operators import components, graph

SHAPE = "image_id long, page long, next long, other long"


def by_hand(pages, root):
    known = {p for p, _, _ in pages}
    out = {p: [t for t in dict.fromkeys((a, b)) if t is not None] for p, a, b in pages}
    depth, level, tree = {root: 0}, [root], set()
    while level:
        new = {}
        for p in sorted(level):
            for t in out[p]:
                if t in known and t not in depth:
                    new.setdefault(t, p)
        tree |= {(p, t) for t, p in new.items()}
        depth |= {t: depth[p] + 1 for t, p in new.items()}
        level = list(new)

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            for t in out[x]:
                if t in known and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return False

    rows = [("visited", p, None, d) for p, d in depth.items()]
    for p, d in depth.items():
        for t in out[p]:
            if t not in known:
                rows.append(("out of range", p, t, d))
            elif (p, t) not in tree:
                rows.append(("cycle" if reaches(t, p) else "duplicate", p, t, d))
    return sorted(map(str, rows))


def test_random_pages(spark):
    rng, rows, want = random.Random(4), [], {}
    for image in range(6):
        pages = [(p, rng.choice([None, rng.randrange(16), p + 1, 99]), rng.choice([None, rng.randrange(16)])) for p in range(15)]
        rows += [(image, *p) for p in pages]
        want[image] = by_hand(pages, 0)
    found = graph.traverse_pages(spark.createDataFrame(rows, SHAPE), spark.createDataFrame([(i, 0) for i in range(6)], "image_id long, page long")).collect()
    for image in range(6):
        assert sorted(str((r.kind, r.page, r.target, r.depth)) for r in found if r.image_id == image) == want[image]


def test_ring_longer_than_the_guard(spark):
    """Leaves of a flat root in one ring: every ring edge comes to a visited page and closes the ring."""
    n = 12
    pages = [(1, 0, 1, n)] + [(1, p, p % n + 1, None) for p in range(1, n + 1)]
    roots = spark.createDataFrame([(1, p) for p in range(1, n + 1)], "image_id long, page long")
    found = graph.traverse_pages(spark.createDataFrame(pages, SHAPE), roots, guard=3).collect()
    assert sorted((r.page, r.target) for r in found if r.kind == "cycle") == [(p, p % n + 1) for p in range(1, n + 1)]
    assert not [r for r in found if r.kind == "duplicate"]


def tarjan(edges):
    """Components of more than one node, as sets."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    order, low, stack, found, n = {}, {}, [], [], 0
    for start in out:
        if start in order:
            continue
        todo = [(start, iter(sorted(out[start])))]
        order[start] = low[start] = n = n + 1
        stack.append(start)
        while todo:
            x, rest = todo[-1]
            for y in rest:
                if y not in order:
                    order[y] = low[y] = n = n + 1
                    stack.append(y)
                    todo.append((y, iter(sorted(out[y]))))
                    break
                if y in stack:
                    low[x] = min(low[x], order[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == order[x]:
                    own = stack[stack.index(x) :]
                    del stack[stack.index(x) :]
                    found.append(frozenset(own))
    return {c for c in found if len(c) > 1}


def components_of(spark, images):
    rows = [(i, a, b) for i, edges in images.items() for a, b in edges]
    found = components.strong_components(spark.createDataFrame(rows, "image_id long, page long, target long")).collect()
    out = {i: {} for i in images}
    for r in found:
        out[r.image_id].setdefault(r.node, set()).add(r.page)
    return {i: {frozenset(c) for c in x.values()} for i, x in out.items()}


def test_components_of_random_graphs(spark):
    rng, images = random.Random(8), {}
    for i in range(12):
        n = rng.randrange(3, 14)
        images[i] = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 3 * n))}
    assert components_of(spark, images) == {i: tarjan(e) for i, e in images.items()}


def test_components_of_long_shapes(spark):
    n = 300
    ring = [(k, (k + 1) % n) for k in range(n)]
    leaves = [(k, k + 1) for k in range(n)] + [(-1, k) for k in range(n)]
    both_ways = [(k, k + 1) for k in range(n)] + [(k + 1, k) for k in range(n)]
    tree = [(k, c) for k in range(250) for c in (2 * k + 1, 2 * k + 2)]
    closing = tree + [(k, (k - 1) // 2 if k % 2 else 0) for k in range(1, 250, 3)]
    images = {0: ring, 1: leaves, 2: both_ways, 3: tree, 4: closing, 5: [*ring, (5, 200), (10, -1), (-1, -2), (-3, 4)]}
    assert components_of(spark, images) == {i: tarjan(e) for i, e in images.items()}


def test_kinds_of_pointers_and_declared_pages(spark):
    pages = [(1, 100, 200, 300, True), (1, 200, 250, 0, True), (1, 300, 900, 100, True), (1, 400, 100, None, False), (2, 100, 0, 0, True), (1, 250, 0, 0, True), (1, 500, 0, 0, True)]
    pages = spark.createDataFrame([(*p[:2], p[2], p[3], p[4]) for p in pages] + [(1, 600, 400, 800, True)], "image_id long, page long, next long, other long, leaf_or_internal boolean")
    roots = spark.createDataFrame([(1, 100), (1, 600), (2, 100)], "image_id long, page long")
    regions = spark.createDataFrame([(1, 100, 850), (2, 0, 1000)], "image_id long, first long, size long")
    found = graph.traverse_pages(pages, roots, regions=regions, page_bytes=100)
    assert sorted((r.kind, r.page, r.target) for r in found.where("image_id = 1 and kind <> 'visited'").collect()) == sorted([("misaligned", 200, 250), ("out of range", 300, 900), ("cycle", 300, 100), ("bad type", 400, None), ("unreadable", 600, 800)], key=str)
    assert {r.page for r in found.where("image_id = 1 and kind = 'visited'").collect()} == {100, 200, 300, 400, 600}
    headers = spark.createDataFrame([(1, 5), (2, 1), (3, None)], "image_id long, declared long")
    assert {r.image_id: (r.n_visited, r.n_cycle, r.state) for r in graph.traversal_report(found, headers).collect()} == {1: (5, 1, "PARTIAL"), 2: (1, 0, "COMPLETE"), 3: (0, 0, "NONE")}
    assert {r.state for r in graph.traversal_report(found.where("image_id = 2"), spark.createDataFrame([(2, 4)], "image_id long, declared long")).collect()} == {"PARTIAL"}


LINKS = "image_id long, block long, first long, prev long, next long, empty boolean"


def chains_by_hand(blocks):
    """blocks: {block: (first, prev, next, empty)}; head: (blocks, last block, mismatches, outcome)."""
    out, held = {}, {}
    for head in sorted(b for b, (first, _, _, empty) in blocks.items() if first == b > 0 and not empty):
        path, bad, at = [head], 0, head
        while True:
            nxt = blocks[at][2]
            if nxt == 0:
                end = "back-link mismatch" if bad else "complete"
            elif nxt == at:
                end = "self-reference"
            elif nxt not in blocks:
                end = "out of range"
            elif blocks[nxt][3]:
                end = "broken at empty slot"
            elif nxt in path:
                end = "loop"
            else:
                bad += blocks[nxt][1] != at
                path.append(nxt)
                at = nxt
                continue
            break
        held[head] = path
        out[head] = (len(path), at, bad, end)
    return {h: v for h, v in out.items() if not any(h in p for g, p in held.items() if g < h)}


def test_random_chains(spark):
    rng, rows, want = random.Random(7), [], {}
    for image in range(40):
        n = rng.choice([1, 3, 8, 20])
        blocks = {b: (b if rng.random() < 0.4 else rng.randrange(n + 1), rng.choice([b - 1, rng.randrange(n + 2)]), rng.choice([b + 1, b + 1, rng.randrange(n + 3)]), rng.random() < 0.1) for b in range(1, n + 1)}
        rows += [(image, b, *v) for b, v in blocks.items()]
        want |= {(image, h): v for h, v in chains_by_hand(blocks).items()}
    got = graph.traverse_chains(spark.createDataFrame(rows, LINKS)).collect()
    assert {(r.image_id, r.head): (r.n_blocks, r.last_block, r.back_mismatches, r.outcome) for r in got} == want and len(got) == len(want)
    assert {v[3] for v in want.values()} == {"complete", "back-link mismatch", "self-reference", "out of range", "broken at empty slot", "loop"}


def test_many_heads_on_one_tail(spark):
    """10,000 heads lead into one tail of 3,000 blocks: one row each, no pairs."""
    tail, heads = 3000, 10_000
    rows = [(1, b, 0, b - 1, b + 1 if b < tail else 0, False) for b in range(1, tail + 1)] + [(1, b, b, 0, 1, False) for b in range(tail + 1, tail + heads + 1)]
    got = graph.traverse_chains(spark.createDataFrame(rows, LINKS)).collect()
    assert len(got) == heads and {(r.n_blocks, r.last_block, r.back_mismatches, r.outcome) for r in got} == {(tail + 1, tail, 1, "back-link mismatch")}
