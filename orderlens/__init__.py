"""orderlens: e-commerce sales analytics on Spark DataFrames.

Load five tables (orders, order items, products, customers, reviews), build the delivered
sales fact and compute revenue, order, product, state and customer-experience metrics for
any year or month against a comparison year.  Every metric is a lazy DataFrame built from
Spark's own expressions.
"""

from .plans.model import SalesModel
from .session import get_spark

__all__ = ["SalesModel", "get_spark"]
