"""Plain versions that several tests compare with."""


def all_pairs(rows, threshold):
    """The class of each (id, text) by comparing all pairs: the least id that links lead to."""
    from proofgrid.llm.neardup import similar

    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(rows):
        for b, y in rows[k + 1 :]:
            if similar(x, y, threshold):
                one, two = find(a), find(b)
                parent[max(one, two)] = min(one, two)
    return {i: find(i) for i in parent}
