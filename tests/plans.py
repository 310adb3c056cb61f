"""Looking at physical plans."""

import re


def plan_nodes(frame):
    """Every operator of a plan with the names of those above it, up to the nearest join."""
    root = frame._jdf.queryExecution().executedPlan()
    todo, found = [(root.initialPlan() if root.nodeName() == "AdaptiveSparkPlan" else root, ())], []
    while todo:
        node, above = todo.pop()
        found.append((node.simpleString(100), above))
        name = node.nodeName()
        below = (name,) if "Join" in name else (*above, name)
        children = node.children()
        todo += [(children.apply(i), below) for i in range(children.size())]
    return found


def above_scan(frame, scan):
    return next(above for text, above in plan_nodes(frame) if re.search(scan, text))
