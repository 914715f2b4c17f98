"""DataFrame operators: resolving, classifying, boxes, evaluation, metrics."""
