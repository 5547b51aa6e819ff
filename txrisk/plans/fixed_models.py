"""Two small constant models, so that scores and explanations can be checked in SQL.

A split is (feature, threshold or list of categories going left, left, right),
a leaf (value, training rows). Numbers are arbitrary; no two features play
the same part, so explanations have no ties.
"""

from __future__ import annotations

from txrisk.ml.tree_tables import TreeModel
from txrisk.schemas import LEGACY_FEATURE_COLUMNS, TRANSFER_FEATURE_COLUMNS

# fixed values
TRANSFER_CATEGORIES = {"card_type": ["CREDIT", "DEBIT"]}
TRANSFER_WEIGHTS = [1.0, 0.31, 0.29, 0.27, 0.23]
TRANSFER_TREES = [
    ("balance_drain_ratio", 0.37,
     ("amount_to_avg_ratio", 2.13, ("txn_hour", 5.5, (-0.41, 310.0), (-0.83, 2911.0)), ("card_age_months", 11.5, (0.17, 402.0), (-0.29, 1377.0))),
     ("amount_to_avg_ratio", 1.07, ("is_new_receiver", 0.5, (-0.23, 733.0), (0.19, 291.0)), ("txn_hour", 17.5, (0.67, 611.0), (0.43, 365.0)))),
    ("velocity_7d", 0.009,
     ("card_type", ["DEBIT"], (-0.37, 1802.0), ("txn_day_of_week", 4.5, (0.21, 771.0), (0.53, 129.0))),
     ("velocity_burst", 6.1, (-0.11, 1999.0), ("card_type", ["CREDIT"], (0.61, 401.0), (0.47, 898.0)))),
    ("previous_fraud_flag", 0.5,
     ("is_round_amount", 0.5, (-0.19, 4409.0), (0.33, 503.0)),
     ("txn_hour", 11.5, ("is_round_amount", 0.5, (0.59, 287.0), (0.97, 101.0)), (0.39, 700.0))),
    ("is_large_amount", 0.5,
     ("card_age_months", 29.5, ("card_age_months", 2.5, (0.27, 149.0), (-0.13, 2203.0)), (-0.31, 2048.0)),
     ("is_weekend", 0.5, (0.57, 1103.0), (0.71, 497.0))),
    ("amount_to_avg_ratio", 4.9,
     ("velocity_24h", 0.02, (-0.07, 2777.0), ("is_off_hours", 0.5, (-0.17, 1301.0), (0.23, 411.0))),
     ("is_off_hours", 0.5, (0.37, 1213.0), (0.73, 298.0))),
]
LEGACY_CATEGORIES = {"card_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "user_id": []}
LEGACY_WEIGHTS = [1.0, 0.37, 0.29, 0.41]
LEGACY_TREES = [
    ("risk_score", 0.53,
     ("amount", 2750.5, (-0.91, 2607.0), ("account_balance", 4011.25, (-0.07, 1123.0), (-0.33, 1270.0))),
     ("amount", 1499.5, ("txn_hour", 7.5, (0.31, 402.0), (0.11, 1703.0)), ("card_age", 595.0, (0.87, 977.0), (0.64, 918.0)))),
    ("card_type", ["BUILDING", "HOUSEHOLD"],
     ("avg_transaction_amount_7d", 1203.5, (-0.27, 1901.0), (0.13, 1699.0)),
     ("card_type", ["MACHINERY"], ("txn_month", 6.5, (0.47, 801.0), (0.29, 799.0)), ("is_weekend", 0.5, (-0.17, 2704.0), (0.09, 1096.0)))),
    ("failed_transaction_count_7d", 0.5,
     ("daily_transaction_count", 0.5, (-0.21, 6103.0), (0.16, 897.0)),
     ("previous_fraudulent_activity", 0.5, (0.39, 1703.0), (0.81, 297.0))),
    ("txn_day_of_week", 2.5,
     ("txn_month", 3.5, (0.07, 1709.0), (-0.12, 2291.0)),
     ("account_balance", 101.5, (0.52, 1301.0), ("amount", 9001.5, (-0.05, 3607.0), (0.34, 1092.0)))),
]


def node_rows(trees: list, categories: dict[str, list[str]]) -> list[tuple]:
    """(tree, node, feature, threshold, categories going left, left, right, value, cover), nodes numbered down from the root."""
    rows = []
    for t, root in enumerate(trees):
        todo, number = [(0, root)], 1
        while todo:
            at, x = todo.pop(0)
            if len(x) == 2:
                rows.append((t, at, None, None, None, None, None, x[0], x[1]))
                continue
            by_category = x[0] in categories
            rows.append((t, at, x[0], None if by_category else x[1], x[1] if by_category else None, number, number + 1, None, _cover(x)))
            todo += [(number, x[2]), (number + 1, x[3])]
            number += 2
    return rows


def _cover(x) -> float:
    return x[1] if len(x) == 2 else _cover(x[2]) + _cover(x[3])


def _model(trees: list, weights: list[float], names: list[str], categories: dict[str, list[str]]) -> TreeModel:
    nodes = []
    for t, node, feature, threshold, goes_left, left, right, value, cover in node_rows(trees, categories):
        known = categories.get(feature)
        nodes.append({"tree": t, "node": node, "feature": None if feature is None else names.index(feature), "threshold": threshold,
                      "left_categories": None if goes_left is None else [known.index(c) for c in goes_left],
                      "n_categories": None if goes_left is None else len(known), "left": left, "right": right,
                      "value": value or 0.0, "cover": cover})
    return TreeModel(names, nodes, weights, categories=categories)


def transfer_model() -> TreeModel:
    return _model(TRANSFER_TREES, TRANSFER_WEIGHTS, TRANSFER_FEATURE_COLUMNS, TRANSFER_CATEGORIES)


def legacy_model() -> TreeModel:
    return _model(LEGACY_TREES, LEGACY_WEIGHTS, LEGACY_FEATURE_COLUMNS, LEGACY_CATEGORIES)
