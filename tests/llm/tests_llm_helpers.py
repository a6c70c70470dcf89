def reached(links):
    """Node -> smallest node reachable, of the nodes that have a link to another."""
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {x: find(x) for x in up}
