"""The same tables in SQL, written from the rules and not from the library's plans."""

_BAR = """(SELECT event_type AS symbol, time_bucket(INTERVAL '{h} hours', e.ts) AS bts, first(value ORDER BY e.ts, e.event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY e.ts, e.event_id) AS close, count(value)::DOUBLE AS volume_base, sum(value) AS volume_quote FROM events e GROUP BY 1, 2)"""

CHAIN = f"""WITH RECURSIVE
b4 AS (SELECT * EXCLUDE (bts), bts AS ts FROM {_BAR.format(h=4)}),
b1 AS (SELECT * EXCLUDE (bts), bts AS ts FROM {_BAR.format(h=1)}),
nx AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM b4),
ann AS (SELECT c.symbol, c.ts, c.open, c.high, c.low, c.close, c.volume_base, c.volume_quote,
  first(f.ts ORDER BY f.high DESC, f.ts) AS high_time, first(f.ts ORDER BY f.low, f.ts) AS low_time
  FROM nx c LEFT JOIN b1 f ON f.symbol = c.symbol AND f.ts >= c.ts AND f.ts < c.nxt
  WHERE c.nxt IS NOT NULL AND c.ts >= (SELECT min(z.ts) FROM b1 z WHERE z.symbol = c.symbol) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM ann),
d AS (SELECT *, coalesce(close - lag(close) OVER w, 0.0) AS delta, coalesce(close - 2 * lag(close) OVER w + lag(close, 2) OVER w, 0.0) AS accel FROM r WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
rng AS (SELECT symbol, min(delta) AS lo, max(delta) AS hi FROM d GROUP BY symbol),
bn AS (SELECT d.*, lo, hi, least(CAST(trunc((delta - lo) / ((hi - lo) + 1e-9) * 10) AS INT), 9) AS bin,
  least(CAST(trunc(CASE WHEN hi = lo THEN 0 ELSE (delta - lo) / (hi - lo) END * 10) AS INT), 9) AS bin2 FROM d JOIN rng USING (symbol)),
wn AS (SELECT *, list(bin) OVER w AS w1, list(bin2) OVER w AS w2 FROM bn WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
en AS (SELECT * EXCLUDE (w1, w2), log2(len(w1)::DOUBLE) - list_sum(list_transform(w1, lambda x: log2(len(list_filter(w1, lambda y: y = x))::DOUBLE))) / len(w1) AS entropy,
  log2(len(w2)::DOUBLE) - list_sum(list_transform(w2, lambda x: log2(len(list_filter(w2, lambda y: y = x))::DOUBLE))) / len(w2) AS entropy2 FROM wn),
ea(symbol, idx, span, y) AS (SELECT symbol, idx, span, accel FROM d, (VALUES (5), (15)) s(span) WHERE idx = 0
  UNION ALL SELECT d.symbol, d.idx, e.span, 2.0 / (e.span + 1) * d.accel + (1 - 2.0 / (e.span + 1)) * e.y FROM ea e JOIN d ON d.symbol = e.symbol AND d.idx = e.idx + 1),
ec(symbol, idx, span, y) AS (SELECT symbol, idx, span, close FROM d, (VALUES (5), (10), (21)) s(span) WHERE idx = 0
  UNION ALL SELECT d.symbol, d.idx, e.span, 2.0 / (e.span + 1) * d.close + (1 - 2.0 / (e.span + 1)) * e.y FROM ec e JOIN d ON d.symbol = e.symbol AND d.idx = e.idx + 1),
rs0 AS (SELECT symbol, sum(greatest(delta, 0)) / 14 AS g, sum(greatest(-delta, 0)) / 14 AS l FROM d WHERE idx BETWEEN 1 AND 14 GROUP BY symbol),
rs(symbol, idx, g, l) AS (SELECT d.symbol, d.idx, g, l FROM d JOIN rs0 USING (symbol) WHERE idx = 14
  UNION ALL SELECT d.symbol, d.idx, (p.g * 13 + greatest(d.delta, 0)) / 14, (p.l * 13 + greatest(-d.delta, 0)) / 14 FROM rs p JOIN d ON d.symbol = p.symbol AND d.idx = p.idx + 1),
rsi AS (SELECT d.symbol, d.idx, coalesce(100 - 100 / (1 + g / (l + 1e-8)), 50.0) AS rsi FROM d LEFT JOIN rs USING (symbol, idx)),
tr AS (SELECT symbol, idx - 1 AS idx, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS pc FROM r) WHERE idx >= 1),
at0 AS (SELECT symbol, avg(tr) AS seed FROM tr WHERE idx < 14 GROUP BY symbol),
ats(symbol, idx, y) AS (SELECT tr.symbol, tr.idx, seed FROM tr JOIN at0 USING (symbol) WHERE idx = 13
  UNION ALL SELECT tr.symbol, tr.idx, (p.y * 13 + tr.tr) / 14 FROM ats p JOIN tr ON tr.symbol = p.symbol AND tr.idx = p.idx + 1),
at1 AS (SELECT symbol, idx, y FROM ats WHERE idx >= 14 UNION ALL
  SELECT symbol, idx, CASE WHEN idx = 0 THEN seed ELSE avg(tr) OVER (PARTITION BY symbol ORDER BY idx) END FROM tr JOIN at0 USING (symbol) WHERE idx < 14),
atr AS (SELECT r.symbol, r.idx, coalesce(y, lag(y) OVER (PARTITION BY r.symbol ORDER BY r.idx)) AS atr FROM r LEFT JOIN at1 ON at1.symbol = r.symbol AND at1.idx = r.idx),
pt AS (SELECT r.*, abs(close - open) AS body, high - greatest(open, close) AS uw, least(open, close) - low AS lw, lag(open) OVER w AS o1, lag(close) OVER w AS c1 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
pn AS (SELECT symbol, idx, body, uw, lw, body <= 0.1 * (high - low) AS doji, body < 0.3 * (uw + lw) AND lw > 2 * body AS hammer, body < 0.3 * (uw + lw) AND uw > 2 * body AS shooting_star,
  coalesce(close > open AND c1 < o1 AND close >= o1 AND open <= c1, false) AS bullish_engulfing, coalesce(close < open AND c1 > o1 AND open >= c1 AND close <= o1, false) AS bearish_engulfing,
  coalesce(c1 < o1 AND close > open AND open < c1 AND close >= o1 + 0.5 * (c1 - o1), false) AS piercing_line,
  coalesce(c1 > o1 AND close < open AND open > c1 AND close <= o1 - 0.5 * (c1 - o1), false) AS dark_cloud_cover FROM pt),
g AS (SELECT (((sa.i * 2 + em.i) * 2 + ac.i) * 2 + tp.i) * 2 + sl.i AS combo_id, sa.v AS sell_after, em.v AS entropy_max, ac.v AS accel_span, tp.v AS tp, sl.v AS sl
  FROM (VALUES (0, 6), (1, 12)) sa(i, v), (VALUES (0, 1.5::DOUBLE), (1, 2.0::DOUBLE)) em(i, v), (VALUES (0, 5), (1, 15)) ac(i, v), (VALUES (0, 0.0::DOUBLE), (1, 40.0::DOUBLE)) tp(i, v), (VALUES (0, 0.0::DOUBLE), (1, 30.0::DOUBLE)) sl(i, v)),
sg AS (SELECT en.symbol, en.idx, span AS accel_span, lag(entropy) OVER w AS e, lag(y) OVER w AS a FROM en JOIN ea ON ea.symbol = en.symbol AND ea.idx = en.idx WINDOW w AS (PARTITION BY en.symbol, span ORDER BY en.idx)),
s AS (SELECT g.*, sg.symbol, sg.idx FROM sg JOIN g ON sg.accel_span = g.accel_span AND sg.e < g.entropy_max WHERE sg.a > 0),
c AS (SELECT s.*, r.n, r.ts, r.close, least(s.idx + sell_after, r.n - 1) AS sell_idx FROM s JOIN r ON r.symbol = s.symbol AND r.idx = s.idx WHERE s.idx + sell_after <= r.n),
t AS (SELECT c.combo_id, c.symbol, c.idx, min(CASE WHEN tp <> 0 AND f.high >= c.close * (1 + tp / 100) THEN f.idx END) AS ti, min(CASE WHEN sl <> 0 AND f.low <= c.close * (1 - sl / 100) THEN f.idx END) AS si
  FROM c LEFT JOIN r f ON f.symbol = c.symbol AND f.idx > c.idx AND f.idx <= c.sell_idx GROUP BY ALL),
x AS (SELECT c.*, ti, si, CASE WHEN ti IS NOT NULL AND (si IS NULL OR ti < si OR (ti = si AND coalesce(h.high_time <= h.low_time, false))) THEN 'TP' WHEN si IS NOT NULL THEN 'SL' ELSE 'SELL_AFTER' END AS exit_reason
  FROM c JOIN t USING (combo_id, symbol, idx) LEFT JOIN r h ON h.symbol = c.symbol AND h.idx = t.ti),
k AS (SELECT x.combo_id, x.symbol, x.idx, x.ts AS buy_time, x.close AS buy_price, e.ts AS sell_time, CASE exit_reason WHEN 'TP' THEN x.close * (1 + tp / 100) WHEN 'SL' THEN x.close * (1 - sl / 100) ELSE e.close END AS sell_price, 100.0 / x.close AS qty, exit_reason
  FROM x JOIN r e ON e.symbol = x.symbol AND e.idx = CASE exit_reason WHEN 'TP' THEN ti WHEN 'SL' THEN si ELSE sell_idx END),
cand AS (SELECT *, qty * buy_price * 0.0005 AS commission_buy, qty * sell_price * 0.0005 AS commission_sell, (sell_price - buy_price) * qty - qty * buy_price * 0.0005 - qty * sell_price * 0.0005 AS profit FROM k),
tl AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS ord FROM (SELECT DISTINCT ts FROM r)),
p AS (SELECT cand.*, b.ord AS buy_ord, greatest(e.ord, b.ord + 1) AS close_ord FROM cand JOIN tl b ON b.ts = buy_time JOIN tl e ON e.ts = sell_time),
bt AS (SELECT combo_id, buy_ord, max(close_ord) AS done FROM p GROUP BY 1, 2),
nb AS (SELECT a.combo_id, a.buy_ord, min(b.buy_ord) AS nxt FROM bt a JOIN bt b ON a.combo_id = b.combo_id AND b.buy_ord >= a.done GROUP BY 1, 2),
wk(combo_id, buy_ord) AS (SELECT combo_id, min(buy_ord) FROM bt GROUP BY 1 UNION ALL SELECT nb.combo_id, nb.nxt FROM wk JOIN nb ON nb.combo_id = wk.combo_id AND nb.buy_ord = wk.buy_ord),
tk AS (SELECT p.*, close_ord <= (SELECT max(ord) FROM tl) AS closed, row_number() OVER (PARTITION BY p.combo_id ORDER BY p.buy_ord, symbol) - 1 AS seq FROM p SEMI JOIN wk ON wk.combo_id = p.combo_id AND wk.buy_ord = p.buy_ord),
px AS (SELECT y.symbol, tl.ord, coalesce((SELECT last(r.close ORDER BY r.ts) FROM r WHERE r.symbol = y.symbol AND r.ts <= tl.ts), (SELECT first(r.close ORDER BY r.ts) FROM r WHERE r.symbol = y.symbol)) AS price FROM (SELECT DISTINCT symbol FROM r) y, tl),
fl AS (SELECT combo_id, ord, sum(flow) AS flow FROM (SELECT combo_id, buy_ord AS ord, -(100.0 + commission_buy) AS flow FROM tk UNION ALL SELECT combo_id, close_ord, qty * sell_price - commission_sell FROM tk WHERE closed) GROUP BY 1, 2),
hv AS (SELECT tk.combo_id, px.ord, sum(qty * price) AS value FROM tk JOIN px ON px.symbol = tk.symbol AND px.ord >= buy_ord AND px.ord < close_ord GROUP BY 1, 2),
eq AS (SELECT g.combo_id, tl.ord, tl.ts, 10000.0 + sum(coalesce(flow, 0)) OVER (PARTITION BY g.combo_id ORDER BY tl.ord) + coalesce(value, 0) AS balance
  FROM g CROSS JOIN tl LEFT JOIN fl ON fl.combo_id = g.combo_id AND fl.ord = tl.ord LEFT JOIN hv ON hv.combo_id = g.combo_id AND hv.ord = tl.ord),
em1 AS (SELECT combo_id, ts, balance, (max(balance) OVER w - balance) / max(balance) OVER w AS dd, balance / lag(balance) OVER w - 1 AS ret, epoch(ts) - epoch(lag(ts) OVER w) AS dt FROM eq WINDOW w AS (PARTITION BY combo_id ORDER BY ts)),
em AS (SELECT combo_id, last(balance ORDER BY ts) AS final_balance, max(dd) AS max_dd, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) * (31536000.0 / median(dt)) / (stddev_pop(ret) * sqrt(31536000.0 / median(dt))) END AS sharpe FROM em1 GROUP BY 1),
ts1 AS (SELECT combo_id, sum(profit) FILTER (closed) AS gain, count(*) AS ns, count(*) FILTER (closed) AS nt, avg((profit > 0)::INT::DOUBLE) FILTER (closed) AS wr, avg(profit) FILTER (closed) AS av, median(profit) FILTER (closed) AS md FROM tk GROUP BY 1),
res AS (SELECT g.*, '__PORTFOLIO__' AS symbol, coalesce(gain, 0) AS "Net_Gain", coalesce(gain, 0) / 100 AS "Net_Gain_pct", coalesce(final_balance, 10000.0) AS "Final_Balance", coalesce(ns, 0) AS "Num_Signals", coalesce(nt, 0) AS "Num_Trades",
  wr AS "Win_Ratio", av AS "Avg_Trade", md AS "Median_Trade", coalesce(max_dd, 0) * 100 AS "DD_pct", sharpe AS "Sharpe" FROM g LEFT JOIN ts1 USING (combo_id) LEFT JOIN em USING (combo_id)),
st AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY idx)) AS step FROM r),
md AS (SELECT symbol, first(step ORDER BY c DESC, step) AS m FROM (SELECT symbol, step, count(*) AS c FROM st WHERE step IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
ft AS (SELECT st.symbol, idx, ts, open, close, (low - open) / open AS pct_ol, (high - open) / open AS pct_oh, (close - open) / open AS pct_oc, coalesce(step, m)::BIGINT AS time_variation, (epoch(low_time) - epoch(ts))::BIGINT AS low_offset, (epoch(high_time) - epoch(ts))::BIGINT AS high_offset FROM st JOIN md USING (symbol)),
dw AS (SELECT symbol, pi AS path_index, si AS step, ('0x' || substr(md5((42 + pi)::VARCHAR || ':' || si::VARCHAR), 1, 12))::BIGINT % n AS row FROM (SELECT symbol, count(*) AS n FROM ft GROUP BY 1), range(4) a(pi), range(60) b(si)),
dj AS (SELECT dw.*, f.pct_ol, f.pct_oh, f.pct_oc, f.time_variation, f.low_offset, f.high_offset, l.open AS p0, l.ts AS t0 FROM dw JOIN ft f ON f.symbol = dw.symbol AND f.idx = dw.row
  JOIN (SELECT symbol, last(open ORDER BY idx) AS open, last(ts ORDER BY idx) AS ts FROM ft GROUP BY 1) l ON l.symbol = dw.symbol),
pc AS (SELECT *, p0 * exp(sum(ln(1 + pct_oc)) OVER w) AS close, sum(time_variation) OVER w AS s FROM dj WINDOW w AS (PARTITION BY symbol, path_index ORDER BY step)),
po AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol, path_index ORDER BY step), p0) AS open FROM pc),
pb AS (SELECT symbol, path_index, step, row, t0 + to_seconds(s) AS ts, open, greatest(open * (1 + pct_oh), close) AS high, least(open * (1 + pct_ol), close) AS low, close, t0 + to_seconds(s + low_offset) AS low_time, t0 + to_seconds(s + high_offset) AS high_time FROM po),
hr AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS nth, ret AS r FROM (SELECT symbol, idx, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY idx)) AS ret FROM r) WHERE ret IS NOT NULL),
pr AS (SELECT symbol, path_index, row_number() OVER (PARTITION BY symbol, path_index ORDER BY step) - 1 AS nth, ret AS r FROM (SELECT symbol, path_index, step, ln(close / lag(close) OVER (PARTITION BY symbol, path_index ORDER BY step)) AS ret FROM pb) WHERE ret IS NOT NULL)
"""


def grid_sql(lists: dict[str, list]) -> str:
    """Rows of a grid with combo_id, the last list running fastest."""
    at, below = [], 1
    for name, values in reversed(lists.items()):
        at.insert(0, f"{name}.i * {below}")
        below *= len(values)
    kind = lambda v: f"{str(v).upper()}::BOOLEAN" if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    tables = ", ".join(f"(VALUES {', '.join(f'({i}, {kind(v)})' for i, v in enumerate(values))}) {name}(i, v)" for name, values in lists.items())
    return f"SELECT {' + '.join(at)} AS combo_id, {', '.join(f'{n}.v AS {n}' for n in lists)} FROM {tables}"


def entropy_sql(p: str, spans: list[int]) -> str:
    """Tables up to {p}_s (k, symbol, idx and the grid's columns) from {p}_r, bars of separate portfolios k, and the grid {p}_g."""
    return f"""{p}_d AS (SELECT *, coalesce(close - lag(close) OVER w, 0.0) AS delta, coalesce(close - 2 * lag(close) OVER w + lag(close, 2) OVER w, 0.0) AS accel FROM {p}_r WINDOW w AS (PARTITION BY k, symbol ORDER BY idx)),
{p}_rng AS (SELECT k, symbol, min(delta) AS lo, max(delta) AS hi FROM {p}_d GROUP BY 1, 2),
{p}_wn AS (SELECT *, list(bin) OVER (PARTITION BY k, symbol ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w1 FROM (SELECT d.*, least(CAST(trunc((delta - lo) / ((hi - lo) + 1e-9) * 10) AS INT), 9) AS bin FROM {p}_d d JOIN {p}_rng USING (k, symbol))),
{p}_en AS (SELECT * EXCLUDE (w1), log2(len(w1)::DOUBLE) - list_sum(list_transform(w1, lambda x: log2(len(list_filter(w1, lambda y: y = x))::DOUBLE))) / len(w1) AS entropy FROM {p}_wn),
{p}_ea(k, symbol, idx, span, y) AS (SELECT k, symbol, idx, span, accel FROM {p}_d, (VALUES {', '.join(f'({s})' for s in spans)}) s(span) WHERE idx = 0
  UNION ALL SELECT d.k, d.symbol, d.idx, e.span, 2.0 / (e.span + 1) * d.accel + (1 - 2.0 / (e.span + 1)) * e.y FROM {p}_ea e JOIN {p}_d d ON d.k = e.k AND d.symbol = e.symbol AND d.idx = e.idx + 1),
{p}_sg AS (SELECT e.k, e.symbol, e.idx, span AS accel_span, lag(entropy) OVER w AS e, lag(y) OVER w AS a FROM {p}_en e JOIN {p}_ea a ON a.k = e.k AND a.symbol = e.symbol AND a.idx = e.idx WINDOW w AS (PARTITION BY e.k, e.symbol, span ORDER BY e.idx)),
{p}_s AS (SELECT g.*, sg.k, sg.symbol, sg.idx FROM {p}_sg sg JOIN {p}_g g ON sg.accel_span = g.accel_span AND sg.e < g.entropy_max WHERE sg.a > 0),
"""


def evaluation_sql(p: str, params: list[str]) -> str:
    """Tables up to {p}_res from {p}_r (k, symbol, idx, n, ts, close, high, low, high_time, low_time), the grid {p}_g and its signals {p}_s: each portfolio k by itself."""
    on = lambda a, b, *c: " AND ".join(f"{a}.{x} = {b}.{x}" for x in c)
    return f"""{p}_c AS (SELECT s.*, r.n, r.ts, r.close, least(s.idx + sell_after, r.n - 1) AS sell_idx FROM {p}_s s JOIN {p}_r r ON {on('r', 's', 'k', 'symbol', 'idx')} WHERE s.idx + sell_after <= r.n),
{p}_t AS (SELECT c.k, c.combo_id, c.symbol, c.idx, min(CASE WHEN tp <> 0 AND f.high >= c.close * (1 + tp / 100) THEN f.idx END) AS ti, min(CASE WHEN sl <> 0 AND f.low <= c.close * (1 - sl / 100) THEN f.idx END) AS si
  FROM {p}_c c LEFT JOIN {p}_r f ON {on('f', 'c', 'k', 'symbol')} AND f.idx > c.idx AND f.idx <= c.sell_idx GROUP BY ALL),
{p}_x AS (SELECT c.*, ti, si, CASE WHEN ti IS NOT NULL AND (si IS NULL OR ti < si OR (ti = si AND coalesce(h.high_time <= h.low_time, false))) THEN 'TP' WHEN si IS NOT NULL THEN 'SL' ELSE 'SELL_AFTER' END AS exit_reason
  FROM {p}_c c JOIN {p}_t USING (k, combo_id, symbol, idx) LEFT JOIN {p}_r h ON {on('h', 'c', 'k', 'symbol')} AND h.idx = ti),
{p}_k AS (SELECT x.k, x.combo_id, x.symbol, x.idx, x.ts AS buy_time, x.close AS buy_price, e.ts AS sell_time, CASE exit_reason WHEN 'TP' THEN x.close * (1 + tp / 100) WHEN 'SL' THEN x.close * (1 - sl / 100) ELSE e.close END AS sell_price, 100.0 / x.close AS qty
  FROM {p}_x x JOIN {p}_r e ON {on('e', 'x', 'k', 'symbol')} AND e.idx = CASE exit_reason WHEN 'TP' THEN ti WHEN 'SL' THEN si ELSE sell_idx END),
{p}_cand AS (SELECT *, qty * buy_price * 0.0005 AS commission_buy, qty * sell_price * 0.0005 AS commission_sell, (sell_price - buy_price) * qty - qty * buy_price * 0.0005 - qty * sell_price * 0.0005 AS profit FROM {p}_k),
{p}_tl AS (SELECT k, ts, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS ord FROM (SELECT DISTINCT k, ts FROM {p}_r)),
{p}_end AS (SELECT k, max(ord) AS last_ord FROM {p}_tl GROUP BY 1),
{p}_p AS (SELECT c.*, b.ord AS buy_ord, greatest(e.ord, b.ord + 1) AS close_ord FROM {p}_cand c JOIN {p}_tl b ON b.k = c.k AND b.ts = buy_time JOIN {p}_tl e ON e.k = c.k AND e.ts = sell_time),
{p}_bt AS (SELECT k, combo_id, buy_ord, max(close_ord) AS done FROM {p}_p GROUP BY 1, 2, 3),
{p}_nb AS (SELECT a.k, a.combo_id, a.buy_ord, min(b.buy_ord) AS nxt FROM {p}_bt a JOIN {p}_bt b ON {on('a', 'b', 'k', 'combo_id')} AND b.buy_ord >= a.done GROUP BY 1, 2, 3),
{p}_wk(k, combo_id, buy_ord) AS (SELECT k, combo_id, min(buy_ord) FROM {p}_bt GROUP BY 1, 2 UNION ALL SELECT nb.k, nb.combo_id, nb.nxt FROM {p}_wk wk JOIN {p}_nb nb ON {on('nb', 'wk', 'k', 'combo_id', 'buy_ord')}),
{p}_tk AS (SELECT p.*, close_ord <= last_ord AS closed FROM {p}_p p JOIN {p}_end USING (k) SEMI JOIN {p}_wk w ON {on('w', 'p', 'k', 'combo_id', 'buy_ord')}),
{p}_px AS (SELECT g.k, g.symbol, g.ord, coalesce(b.close, f.close) AS price FROM (SELECT y.k, y.symbol, t.ord, t.ts FROM (SELECT DISTINCT k, symbol FROM {p}_r) y JOIN {p}_tl t ON t.k = y.k) g
  ASOF LEFT JOIN {p}_r b ON b.k = g.k AND b.symbol = g.symbol AND g.ts >= b.ts JOIN (SELECT k, symbol, first(close ORDER BY ts) AS close FROM {p}_r GROUP BY 1, 2) f ON f.k = g.k AND f.symbol = g.symbol),
{p}_fl AS (SELECT k, combo_id, ord, sum(flow) AS flow FROM (SELECT k, combo_id, buy_ord AS ord, -(100.0 + commission_buy) AS flow FROM {p}_tk UNION ALL SELECT k, combo_id, close_ord, qty * sell_price - commission_sell FROM {p}_tk WHERE closed) GROUP BY 1, 2, 3),
{p}_hv AS (SELECT t.k, t.combo_id, px.ord, sum(qty * price) AS value FROM {p}_tk t JOIN {p}_px px ON {on('px', 't', 'k', 'symbol')} AND px.ord >= buy_ord AND px.ord < close_ord GROUP BY 1, 2, 3),
{p}_eq AS (SELECT l.k, g.combo_id, l.ord, l.ts, 10000.0 + sum(coalesce(flow, 0)) OVER (PARTITION BY l.k, g.combo_id ORDER BY l.ord) + coalesce(value, 0) AS balance
  FROM {p}_g g CROSS JOIN {p}_tl l LEFT JOIN {p}_fl f ON f.k = l.k AND f.combo_id = g.combo_id AND f.ord = l.ord LEFT JOIN {p}_hv h ON h.k = l.k AND h.combo_id = g.combo_id AND h.ord = l.ord),
{p}_em1 AS (SELECT k, combo_id, ts, balance, (max(balance) OVER w - balance) / max(balance) OVER w AS dd, balance / lag(balance) OVER w - 1 AS ret, epoch(ts) - epoch(lag(ts) OVER w) AS dt FROM {p}_eq WINDOW w AS (PARTITION BY k, combo_id ORDER BY ts)),
{p}_em AS (SELECT k, combo_id, last(balance ORDER BY ts) AS final_balance, max(dd) AS max_dd, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) * (31536000.0 / median(dt)) / (stddev_pop(ret) * sqrt(31536000.0 / median(dt))) END AS sharpe FROM {p}_em1 GROUP BY 1, 2),
{p}_ts1 AS (SELECT k, combo_id, sum(profit) FILTER (closed) AS gain, count(*) AS ns, count(*) FILTER (closed) AS nt, avg((profit > 0)::INT::DOUBLE) FILTER (closed) AS wr, avg(profit) FILTER (closed) AS av, median(profit) FILTER (closed) AS md FROM {p}_tk GROUP BY 1, 2),
{p}_res AS (SELECT e.k, g.combo_id, {', '.join(f'g.{x}' for x in params)}, '__PORTFOLIO__' AS symbol, coalesce(gain, 0) AS "Net_Gain", coalesce(gain, 0) / 100 AS "Net_Gain_pct", coalesce(final_balance, 10000.0) AS "Final_Balance", coalesce(ns, 0) AS "Num_Signals", coalesce(nt, 0) AS "Num_Trades",
  wr AS "Win_Ratio", av AS "Avg_Trade", md AS "Median_Trade", coalesce(max_dd, 0) * 100 AS "DD_pct", sharpe AS "Sharpe" FROM {p}_g g CROSS JOIN {p}_end e LEFT JOIN {p}_ts1 t ON t.k = e.k AND t.combo_id = g.combo_id LEFT JOIN {p}_em m ON m.k = e.k AND m.combo_id = g.combo_id)"""
