"""Exposures near a whole number: a cap's units must not depend on the order of a tick's rows."""

from tapeline.operators import signals

NEAR = 0.9999999999999998
#: Positions and deltas by strike; in strike order they add up to 4e-15, in others to 0.
STRIKES = [(9700, 18, 1.0), (9800, 19, 1.0), (9900, 20, 1.0), (10000, -20, 1.0), (10100, -19, 1.0), (10200, -18, NEAR)]


def added(rows):
    """Terms one after the other; the built-in sum compensates."""
    total = 0.0
    for _, position, delta in rows:
        total += position * delta
    return total


def test_exposure_adds_up_in_strike_order(spark):
    want = added(STRIKES)
    assert want != added(STRIKES[::-1])
    wanted = spark.createDataFrame([(0, 100, s, 15, 10, d, p, 9, 12) for s, p, d in STRIKES], "day int, timestamp long, strike int, quantity long, price long, delta double, position long, bid long, ask long")
    orders = set()
    for turned in (STRIKES, STRIKES[::-1], STRIKES[3:] + STRIKES[:3], STRIKES[::2] + STRIKES[1::2]):
        held = spark.createDataFrame([(0, 100, s, p, d) for s, p, d in turned], "day int, timestamp long, strike int, position long, delta double").coalesce(1)
        exposure = signals.net_exposure(held)
        assert exposure.first().exposure == want
        orders.add(tuple((r.strike, r.quantity) for r in signals.capped_in_turn(wanted, exposure, 40.0).orderBy("strike").collect()))
    assert len(orders) == 1


def test_unquoted_and_missing_positions(spark):
    rows = [(0, 100, None, 7, 1.0), (0, 100, 9700, 4, 0.5), (0, 100, 9800, 3, None), (0, 100, 9900, None, 0.5), (0, 200, 9700, 5, None), (0, 300, 9700, None, 1.0)]
    held = spark.createDataFrame(rows, "day int, timestamp long, strike int, position long, delta double")
    assert {r.timestamp: r.exposure for r in signals.net_exposure(held).collect()} == {100: 9.0, 200: 0.0, 300: None}
