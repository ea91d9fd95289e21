"""Plain Python forms of the operators, for small inputs only."""

import hashlib
import heapq
import json
from collections import defaultdict, deque


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def canonical(payload) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))


def table_digest(columns, rows) -> str:
    body = {"schema": columns, "rows": [dict(zip(columns, r)) for r in sorted(rows)]}
    return sha(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n")


def reach(edges, seeds, depth):
    down = defaultdict(set)
    for u, v in edges:
        down[u].add(v)
    distance = {}
    queue = deque((s, 0) for s in seeds)
    while queue:
        node, d = queue.popleft()
        if node in distance:
            continue
        distance[node] = d
        if d < depth:
            queue.extend((n, d + 1) for n in down[node])
    return distance


def closure(edges, targets, availability):
    up = defaultdict(set)
    for u, v in edges:
        up[v].add(u)
    found, todo = set(targets), list(targets)
    while todo:
        for parent in up[todo.pop()]:
            if availability[parent] == "unavailable" and parent not in found:
                found.add(parent)
                todo.append(parent)
    return found


def induced(edges, targets):
    return {(u, v) for u, v in edges if u in targets and v in targets}


def waves(edges, targets):
    """wave per node, and the nodes that never become ready."""
    inner, left, out = induced(edges, targets), set(targets), {}
    wave = 0
    while left:
        wave += 1
        blocked = {v for u, v in inner if u in left and v in left}
        ready = left - blocked
        if not ready:
            break
        for node in ready:
            out[node] = wave
        left -= ready
    return out, left


def least_first_order(edges, targets):
    """Always take the least ready node."""
    inner = induced(edges, targets)
    waiting = {n: sum(v == n for _, v in inner) for n in targets}
    heap = sorted(n for n, k in waiting.items() if k == 0)
    order = []
    while heap:
        node = heapq.heappop(heap)
        order.append(node)
        for u, v in inner:
            if u == node:
                waiting[v] -= 1
                if waiting[v] == 0:
                    heapq.heappush(heap, v)
    return order


def cyclic_core(edges, targets):
    """Nodes left after removing, again and again, nodes without a parent or without a child."""
    left = set(targets)
    while True:
        inner = induced(edges, left)
        keep = {u for u, _ in inner} & {v for _, v in inner}
        if keep == left:
            return left
        left = keep


def admit(rows, limit):
    """rows: (at, tie, until) of one key; returns {tie: admitted}."""
    held, out = [], {}
    for at, tie, until in sorted(rows):
        held = [x for x in held if x > at]
        out[tie] = len(held) < limit
        if out[tie]:
            held.append(until)
    return out
