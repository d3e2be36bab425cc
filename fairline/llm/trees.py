"""Fitted Spark trees as plain nested tuples, and the paths through them."""


def nested(node) -> tuple:
    """(feature, threshold, left, right) with left for feature <= threshold, or (prediction,) for a leaf; node: a JVM node."""
    if node.subtreeDepth() == 0:
        return (float(node.prediction()),)
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), nested(node.leftChild()), nested(node.rightChild())


def decided(tree: tuple, features) -> float:
    """The leaf's prediction."""
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def paths(tree: tuple, above: tuple = ()) -> list[tuple]:
    """Every path from the root to an inner node or leaf, as conditions (feature, "<=" or ">", threshold)."""
    found = [above] if above else []
    if len(tree) > 1:
        feature, threshold, left, right = tree
        found += paths(left, (*above, (feature, "<=", threshold))) + paths(right, (*above, (feature, ">", threshold)))
    return found
