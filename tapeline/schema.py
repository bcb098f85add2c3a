"""Schemas of the tapes."""

from pyspark.sql import types as T

LEVELS = (1, 2, 3)
# The columns of the two tapes, in file order.
PRICE_COLUMNS = (
    "day", "timestamp", "product",
    "bid_price_1", "bid_volume_1", "bid_price_2", "bid_volume_2", "bid_price_3", "bid_volume_3",
    "ask_price_1", "ask_volume_1", "ask_price_2", "ask_volume_2", "ask_price_3", "ask_volume_3",
    "mid_price", "profit_and_loss",
)
TRADE_COLUMNS = ("timestamp", "buyer", "seller", "symbol", "currency", "price", "quantity")

_KINDS = {"day": T.IntegerType(), "timestamp": T.LongType(), "quantity": T.LongType(), "price": T.DoubleType()}
_TEXT = {"product", "buyer", "seller", "symbol", "currency"}


def _kind(name: str) -> T.DataType:
    return T.StringType() if name in _TEXT else _KINDS.get(name, T.DoubleType())


PRICES = T.StructType([T.StructField(c, _kind(c)) for c in PRICE_COLUMNS])
TRADES = T.StructType([T.StructField(c, _kind(c)) for c in TRADE_COLUMNS])
SIDE = T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("v", T.LongType())]))
