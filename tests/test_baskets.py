import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tests.data import as_dicts, metrics, transactions
from tillroll.operators import baskets


def random_baskets(seed, invoices=40, products=9):
    generator = random.Random(seed)
    rows = []
    for invoice in range(invoices):
        size = products if invoice % 7 == 0 else generator.randint(1, 4)
        for product in generator.sample(range(products), size):
            for _ in range(generator.randint(1, 2)):
                rows.append(
                    {"InvoiceNo": f"i{invoice}", "Description": f"p{product}", "UnitPrice": generator.randint(1, 9) * 1.0}
                )
    return rows


def brute_force(rows, min_together):
    by_invoice = defaultdict(list)
    for row in rows:
        by_invoice[row["InvoiceNo"]].append(row)
    times, money = Counter(), Counter()
    for lines in by_invoice.values():
        seen = set()
        for x in lines:
            for y in lines:
                if x["Description"] < y["Description"]:
                    pair = (x["Description"], y["Description"])
                    seen.add(pair)
                    money[pair] += x["UnitPrice"] + y["UnitPrice"]
        times.update(seen)
    return {pair: (n, money[pair]) for pair, n in times.items() if n >= min_together}


@pytest.mark.parametrize("seed, min_together, block", [(1, 4, 5), (2, 6, 5), (3, 2, 1), (4, 1, 1), (5, 5, 1000)])
def test_affinity_equals_brute_force(spark, seed, min_together, block):
    rows = random_baskets(seed)
    found = baskets.product_affinity(transactions(spark, rows), min_together, 1000, block)
    mine = {
        (r["Product_A"], r["Product_B"]): (r["TimesBoughtTogether"], r["CombinedRevenue"]) for r in as_dicts(found)
    }
    assert mine == brute_force(rows, min_together) and mine


def test_repeated_product_counts_one_invoice_and_all_row_pairs(spark):
    rows = [{"Description": "a", "UnitPrice": 1.0}, {"Description": "a", "UnitPrice": 2.0}, {"Description": "b", "UnitPrice": 5.0}]
    (pair,) = as_dicts(baskets.product_affinity(transactions(spark, rows), 1))
    assert pair["TimesBoughtTogether"] == 1 and pair["CombinedRevenue"] == (1 + 5) + (2 + 5)


def test_netted_products_are_not_in_the_basket(spark):
    rows = [
        {"InvoiceNo": "1", "Description": "a", "Quantity": 5},
        {"InvoiceNo": "1", "Description": "a", "Quantity": -5, "StockCode": "t"},
        {"InvoiceNo": "1", "Description": "b"},
        {"InvoiceNo": "2", "Description": "b"},
        {"InvoiceNo": "2", "Description": "c"},
    ]
    tx = transactions(spark, rows)
    assert as_dicts(baskets.best_seller_pairs(tx)) == [{"Product_A": "b", "Product_B": "c", "Count": 1}]
    summary = metrics(baskets.affinity_summary(tx))
    assert summary["top_pair"] == (1.0, "b + c") and summary["mean_basket_size"][0] == 1.5


def test_best_sellers_limit_the_pairs(spark):
    rows = random_baskets(7)
    sold = Counter(r["Description"] for r in rows)
    top = sorted(sold, key=lambda p: (-sold[p], p))[:3]
    by_invoice = defaultdict(set)
    for row in rows:
        by_invoice[row["InvoiceNo"]].add(row["Description"])
    expected = Counter(p for items in by_invoice.values() for p in combinations(sorted(items & set(top)), 2))
    mine = {(r["Product_A"], r["Product_B"]): r["Count"] for r in as_dicts(baskets.best_seller_pairs(transactions(spark, rows), 3))}
    assert mine == dict(expected)


def test_pairs_are_joined_by_invoice_not_crossed(spark):
    plan = baskets.best_seller_pairs(transactions(spark, random_baskets(1)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_large_basket_is_spread(spark):
    lines = spark.range(2000).selectExpr("'one' AS InvoiceNo", "concat('p', id) AS Description", "1 AS lines", "CAST(1 AS DECIMAL(24, 8)) AS money")
    pairs = baskets._pairs(lines, 256)
    assert pairs.select("Product_A", "Product_B").distinct().count() == pairs.count() == 2000 * 1999 // 2


def test_a_row_is_repeated_for_smaller_names_only(spark, monkeypatch):
    lines = spark.range(100).selectExpr("'one' AS InvoiceNo", "format_string('p%03d', id) AS Description", "1 AS lines", "CAST(1 AS DECIMAL(24, 8)) AS money")
    joined, join = [], type(lines).join
    monkeypatch.setattr(type(lines), "join", lambda a, b, *on: (joined.append((a, b)), join(a, b, *on))[1])
    baskets._pairs(lines, 10)
    a, b = joined[-1]
    assert a.count() == 100 and b.count() == sum(1 + (place - 1) // 10 for place in range(1, 100))
