"""The settlement fold against a plain day-by-day loop, and hand cases of splits and single dividends."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import settlement as S

RECORD = "id long, ticker string, entry_session int, horizon int, sign int, style string, strike double, expiry_session int, stock_only boolean, stock_entry double, option_entry double, cost_multiplier double, ineligible string"
HORIZON, RETRIES = 6, 2


def loop(record, marks, dividends, splits):
    """What a holder meets, one session after the other."""
    r = record
    last = r["entry_session"] + r["horizon"] + RETRIES
    shares, received, gaps, lowest, why, exit_at, s, o = 100.0, 0.0, 0, None, None, None, None, None
    held = not r["stock_only"]

    def cost(shares, stock, option):
        return r["cost_multiplier"] * (shares * stock * S.STOCK_FRICTION + (100 * option * S.OPTION_FRICTION + S.OPTION_FEE if held else 0))

    opening = cost(100, r["stock_entry"], r["option_entry"])
    previous = (None, None)
    for i in range(r["entry_session"], last + 1):
        if i not in marks:
            continue
        stock, option = marks[i]
        if i > r["entry_session"]:
            own = [x for x in splits if x[0] == i]
            if own:
                if any(a <= 0 or b <= 0 for _, a, b in own):
                    why = S.SPLIT_UNKNOWN
                for _, a, b in own:
                    if why is None:
                        shares *= a / b
                if why is None and held:
                    why = S.SPLIT_DELIVERABLE
                elif why is None and abs(shares - round(shares)) > 1e-9:
                    why = S.SPLIT_FRACTION
            paid = sorted(x for x in dividends if x[0] == i)
            if why is None and any(x[4] != "USD" for x in paid):
                why = S.DIVIDEND_UNSUPPORTED
            if why is None:
                for _, _, declared, cash, _ in paid:
                    p, q = previous
                    if held and r["sign"] == -1 and r["style"] == "american" and declared <= i - 1 and p is not None and q is not None and p > r["strike"] and q - (p - r["strike"]) < cash:
                        why, s, o = S.ASSIGNED, r["strike"], 0.0
                        break
                    received += shares * cash
            if why is None and held and i >= r["expiry_session"]:
                if stock is None:
                    why = S.EXPIRY_MISSING
                else:
                    inside = stock > r["strike"] if r["sign"] == -1 else stock < r["strike"]
                    why, s, o = (S.EXERCISED, r["strike"], 0.0) if inside else (S.WORTHLESS, stock, 0.0)
            if why is None and i >= r["entry_session"] + r["horizon"] and stock is not None and (not held or option is not None):
                why, s, o = S.SCHEDULED, stock, option if held else 0.0
            if why is not None:
                exit_at = i
                break
        ms = stock if stock is not None else previous[0]
        mo = 0.0 if not held else option if option is not None else previous[1]
        if ms is None or mo is None:
            gaps += 1
        else:
            net = (shares * ms - 100 * r["stock_entry"] + (r["sign"] * 100 * (mo - r["option_entry"]) if held else 0) + received - opening - cost(shares, ms, mo)) / (100 * r["stock_entry"])
            lowest = net if lowest is None else min(lowest, net)
        previous = (stock, option)
    return exit_at, why or S.UNFILLED, s, o, shares, received, lowest, gaps


def settled(spark, records, marks, dividends, splits):
    """dividends: (session, accession, declared session, cash, currency); dates are session numbers."""
    rows = spark.createDataFrame([tuple(r[c.split()[0]] for c in RECORD.split(", ")) for r in records], RECORD)
    m = spark.createDataFrame([("T", i, s, o) for i, (s, o) in marks.items()], "ticker string, session int, stock double, option double")
    d = spark.createDataFrame([("T", i, a, decl, i - 1, c, k) for i, a, decl, c, k in dividends], "ticker string, session int, accession long, declared int, previous_date int, cash double, currency string")
    p = spark.createDataFrame([("T", *x) for x in splits], "ticker string, session int, split_to int, split_from int")
    return {r["id"]: r for r in S.settle(S.paths(rows, m, S.action_days(d, p), RETRIES), ["id", "stock_only"]).collect()}


def record(i, **changed):
    return {"id": i, "ticker": "T", "entry_session": 1, "horizon": HORIZON, "sign": -1, "style": "american", "strike": 50.0, "expiry_session": 30, "stock_only": False, "stock_entry": 50.0,
            "option_entry": 2.0, "cost_multiplier": 1.0, "ineligible": None} | changed


FLAT = {i: (50.0, 2.0) for i in range(0, 20)}


def test_a_split_changes_shares_and_later_dividends(spark):
    got = settled(spark, [record(1, stock_only=True), record(2)], FLAT, [(5, 1, 0, 0.5, "USD")], [(4, 2, 1)])
    assert got[1]["shares_exit"] == 200 and got[1]["dividends"] == 100 and got[1]["exit_reason"] == S.SCHEDULED
    assert got[2]["exit_reason"] == S.SPLIT_DELIVERABLE and got[2]["exit_session"] == 4 and got[2]["stock_exit"] is None


@pytest.mark.parametrize("parts,why", [((0, 1), S.SPLIT_UNKNOWN), ((1, 0), S.SPLIT_UNKNOWN), ((3, 7), S.SPLIT_FRACTION), ((3, 2), S.SCHEDULED)])
def test_split_ratios(spark, parts, why):
    assert settled(spark, [record(1, stock_only=True)], FLAT, [], [(4, *parts)])[1]["exit_reason"] == why


def test_each_dividend_is_tried_alone(spark):
    # Time value 1.5: neither half dividend is worth it, although both together are.
    marks = FLAT | {3: (52.0, 3.5)}
    low = settled(spark, [record(1)], marks, [(4, 1, 0, 1.0, "USD"), (4, 2, 0, 1.0, "USD")], [])[1]
    assert low["exit_reason"] == S.SCHEDULED and low["dividends"] == 200
    # The second one is: what came before it is paid, what comes after it is not.
    high = settled(spark, [record(1)], marks, [(4, 1, 0, 1.0, "USD"), (4, 2, 0, 1.6, "USD"), (4, 3, 0, 9.0, "USD")], [])[1]
    assert high["exit_reason"] == S.ASSIGNED and high["exit_session"] == 4 and high["dividends"] == 100 and high["stock_exit"] == 50
    # A dividend that was not announced before its day calls nothing.
    late = settled(spark, [record(1)], marks, [(4, 1, 4, 9.0, "USD")], [])[1]
    assert late["exit_reason"] == S.SCHEDULED and late["dividends"] == 900


def test_random_records(spark):
    rng = random.Random(11)
    for trial in range(3):
        marks = {i: (None if rng.random() < 0.15 else rng.uniform(45, 56), None if rng.random() < 0.2 else rng.uniform(0.2, 6)) for i in range(40) if rng.random() < 0.95}
        dividends = [(rng.randrange(40), a, rng.randrange(40), rng.choice([0.1, 0.5, 2.0, 4.0]), "CAD" if rng.random() < 0.06 else "USD") for a in range(45)]
        splits = [(rng.randrange(40), rng.choice([2, 3, 0]), rng.choice([1, 2, 7])) for _ in range(3)]
        records = [record(i, entry_session=rng.randrange(25), sign=rng.choice([-1, 1]), style=rng.choice(["american", "european"]), strike=rng.choice([48.0, 50.0, 52.0]),
                          expiry_session=rng.choice([8, 15, 60]), stock_only=rng.random() < 0.4, cost_multiplier=rng.choice([1.0, 2.0])) for i in range(150)]
        got = settled(spark, records, marks, dividends, splits)
        for r in records:
            want = loop(r, marks, dividends, splits)
            row = got.get(r["id"])
            if row is None:  # no session of its path exists
                assert want[0] is None
                continue
            have = tuple(row[c] for c in ("exit_session", "exit_reason", "stock_exit", "option_exit", "shares_exit", "dividends", "lowest", "mark_gaps"))
            assert have[:2] == want[:2], (r, have, want)
            for a, b in zip(have[2:], want[2:]):
                assert a == b or abs(a - b) < 1e-9, (r, have, want)


def test_outcome_columns(spark):
    rows = spark.createDataFrame([tuple(record(1, stock_only=True)[c.split()[0]] for c in RECORD.split(", ")), tuple(record(2, ineligible="too_thin")[c.split()[0]] for c in RECORD.split(", "))], RECORD)
    marks = spark.createDataFrame([("T", i, 50.0 + i, 2.0) for i in range(20)], "ticker string, session int, stock double, option double")
    none = spark.createDataFrame([], "ticker string, session int, accession long, declared int, previous_date int, cash double, currency string")
    split = spark.createDataFrame([], "ticker string, session int, split_to int, split_from int")
    done = S.settle(S.paths(rows.where("ineligible is null"), marks, S.action_days(none, split), RETRIES), ["id", "stock_only"])
    got = {r["id"]: r for r in S.outcomes(rows, done, ["id", "stock_only"]).collect()}
    assert got[1]["status"] == "completed" and got[1]["evaluation_aligned"] and got[1]["path_complete"] and got[1]["stock_pnl"] == 700
    assert got[2]["status"] == "too_thin" and got[2]["net_return"] is None and got[2]["downside_loss"] is None
    assert rows.where(F.col("ineligible").isNotNull()).count() == 1
