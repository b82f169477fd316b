"""Generated tasks: parameters drawn by hash from a counter, the right answer worked out, distractors by known mistakes.

Every generator is one projection of ``range(n)``, so it makes as many rows as
asked for without a shuffle. Texts are this library's own.
"""

from .base import literal, sql

N = 200


def key(name, what):
    return f"concat('{name}:', i, ':{what}')"


def number(d, name, what, lo, hi):
    """A whole number from lo to hi."""
    return f"({lo} + {d.draw(key(name, what), hi - lo + 1)})"


def choice(d, name, what, items):
    return d.pick(items, d.draw(key(name, what), len(items)))


def money(d, cents):
    return f"concat('$', {d.commas(f'floor(({cents}) / 100)')}, '.', lpad(CAST(CAST(({cents}) % 100 AS int) AS string), 2, '0'))"


def dollars(d, x):
    return f"concat('$', {d.commas(x)})"


def layers(d, *steps):
    """range(n) as i, then a subquery for each dict of named expressions."""
    out = d.seq(N)
    for k, step in enumerate(steps):
        out = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {out} AS s{k})"
    return out


def question(d, name, state, right, wrong, spare, *steps):
    """Four options in a drawn order; a distractor that repeats an earlier option gives way to the spare one."""
    distinct = {"o0": right, "w1": wrong[0], "w2": wrong[1], "w3": wrong[2], "extra": spare}
    first = {"o1": "CASE WHEN w1 = o0 THEN extra ELSE w1 END"}
    second = {"o2": "CASE WHEN w2 IN (o0, o1) THEN extra ELSE w2 END", "r": d.draw(key(name, "order"), 4)}
    third = {"o3": "CASE WHEN w3 IN (o0, o1, o2) THEN extra ELSE w3 END"}
    options = d.arr("o0", "o1", "o2", "o3")
    at = lambda p: d.at(options, f"({p} - r + 4) % 4")
    inner = layers(d, *steps, {"state": state}, distinct, first, second, third)
    return f"SELECT concat('{name}_', i) AS id, state, {at(0)} AS a, {at(1)} AS b, {at(2)} AS c, {at(3)} AS d, chr(65 + r) AS gold FROM {inner} AS q"


def sla(d):
    """A deadline in business hours, Monday to Friday from 9 to 17. Wrong: the clock running on, a business day more, weekends counted."""
    n = "sla"
    return question(
        d, n, f"concat('Ticket ', i, ' was opened on ', {d.stamp(d.moment('base', 'minute'))}, ' and is due after ', hours, ' business hours (Monday to Friday, 09:00 to 17:00).')",
        d.stamp(d.moment("due", "due_minute")), [d.stamp(d.moment("base", "minute + hours * 60")), d.stamp(d.moment(d.days("due", "CASE WHEN (w + q) % 5 < 4 THEN 1 ELSE 3 END"), "due_minute")), d.stamp(d.moment(d.days("base", "q"), "due_minute"))],
        d.stamp(d.moment("due", "due_minute + 120")),
        {"month_": choice(d, n, "month", [3, 4, 5, 6, 9, 10]), "w": number(d, n, "day", 0, 4), "hours": choice(d, n, "hours", [12, 16, 20, 24, 28]), "minute": f"{choice(d, n, 'hour', [9, 10, 11, 13, 14, 15])} * 60 + {choice(d, n, 'minute', [0, 15, 30, 45])}"},
        {"base": d.days("make_date(2026, month_, 1)", f"(w - {d.weekday('make_date(2026, month_, 1)')} + 7) % 7"), "rest": "hours * 60 - (1020 - minute)"},
        {"q": "CAST(greatest(ceil(rest / 480e0), 0) AS int)"},
        {"due": d.days("base", "q + 2 * floor((w + q) / 5)"), "due_minute": "CASE WHEN q = 0 THEN minute + hours * 60 ELSE 540 + rest - 480 * (q - 1) END"},
    )


CITIES = [("San Francisco", "PST", -8), ("New York", "EST", -5), ("London", "GMT", 0), ("Tokyo", "JST", 9), ("Sydney", "AEDT", 11)]


def span(d):
    """Alarms in four cities; the time from first to last. Wrong: local clocks compared, off by the gap of the zones, an hour and a half more."""
    n = "span"
    long = lambda x: f"concat(CAST(floor(({x}) / 60) AS int), ' hours and ', CAST(({x}) % 60 AS int), ' minutes')"
    city = lambda k, what: d.pick([c[what] for c in CITIES], f"(start + {k} * step) % 5")
    day = "DATE '2026-07-10'"
    line = lambda k: f"'; ', {city(k, 0)}, ': ', {d.stamp(d.moment(day, f'utc + delta{k} + 60 * {city(k, 2)}'))}, ' less its offset, in ', {city(k, 1)}"
    gap = f"({city(3, 2)} - {city(0, 2)}) * 60"
    return question(
        d, n, f"concat('Alarm log', {line(0)}, {line(1)}, {line(2)}, {line(3)})", long("total"), [long("naive"), long("off"), long("total + 90")], "concat(CAST(floor((total + 60) / 60) AS int), ' hours and ', CAST((total + 30) % 60 AS int), ' minutes')",
        {"start": number(d, n, "city", 0, 4), "step": number(d, n, "step", 1, 4), "utc": f"{number(d, n, 'hour', 4, 18)} * 60 + {choice(d, n, 'minute', [0, 15, 30, 45])}", "delta0": "0", "delta1": number(d, n, "d1", 45, 120), "delta2": number(d, n, "d2", 150, 300), "delta3": number(d, n, "d3", 350, 500)},
        {"total": "delta3", "naive": f"abs(delta3 + {gap})", "off": f"abs(delta3 - abs({gap}))"},
    )


def pricing(d):
    """A bill in three tiers, in cents. Wrong: all at the last rate, all at the first, the second tier from zero on."""
    n = "tier"
    return question(
        d, n, f"concat('First ', t1, ' units at ', r1, ' cents, up to ', t2, ' at ', r2, ' cents, above at ', r3, ' cents; used: ', t2 + excess, ' units.')", money(d, "t1 * r1 + (t2 - t1) * r2 + excess * r3"),
        [money(d, "(t2 + excess) * r3"), money(d, "(t2 + excess) * r1"), money(d, "t2 * r2 + excess * r3")], money(d, "t1 * r1 + (t2 - t1) * r2 + excess * r3 + 15000"),
        {"t1": choice(d, n, "t1", [1000, 2000, 5000]), "r1": choice(d, n, "r1", [10, 12, 15]), "r2": choice(d, n, "r2", [8, 9, 10]), "r3": choice(d, n, "r3", [5, 6, 7]), "excess": number(d, n, "excess", 500, 2500)}, {"t2": f"t1 + {choice(d, n, 't2', [3000, 5000, 8000])}"},
    )


def bayes(d):
    """The chance of the condition after a positive test. Wrong: the sensitivity, less the false positives, these alone."""
    n = "bayes"
    pct = lambda x: f"concat({d.tenths(x)}, '%')"
    post = "100e0 * sens * prev / (sens * prev + fpr * (100 - prev))"
    return question(
        d, n, "concat('Prevalence ', prev, '%, sensitivity ', sens, '%, false positives ', fpr, '%; the test is positive.')", pct(post), [pct("sens * 1e0"), pct("(sens - fpr) * 1e0"), pct("fpr * 1e0")], pct(f"{post} + 12.5e0"),
        {"prev": choice(d, n, "prev", [1, 2, 5]), "sens": choice(d, n, "sens", [90, 95, 98]), "fpr": choice(d, n, "fpr", [4, 5, 8])},
    )


def emv(d):
    """Which of two options has the higher expected value net of cost. Wrong: the other one, the gross value, no difference."""
    n = "emv"
    value = lambda o: f"CAST((bull * {o}_bull + base * {o}_base + (100 - bull - base) * {o}_bear) / 100 - {o}_cost AS bigint)"
    pay = {"a_bull": [300000, 400000, 500000], "a_base": [120000, 160000, 200000], "a_bear": [-20000, 0, 30000], "b_bull": [180000, 220000, 250000], "b_base": [100000, 120000, 140000], "b_bear": [40000, 50000, 60000], "a_cost": [50000, 100000, 150000], "b_cost": [30000, 60000, 80000], "bull": [20, 25, 30], "base": [40, 50]}
    take = lambda o, kind, x: f"concat('Select Option ', {o}, ' ({kind} Expected Value: ', {dollars(d, x)}, ')')"
    return question(
        d, n, "concat('Growth ', bull, '%, steady ', base, '%, else contraction. A costs ', a_cost, ' and pays ', a_bull, ', ', a_base, ', ', a_bear, '; B costs ', b_cost, ' and pays ', b_bull, ', ', b_base, ', ', b_bear, '.')",
        take("best", "Net", "greatest(ea, eb)"), [take("CASE best WHEN 'A' THEN 'B' ELSE 'A' END", "Net", "least(ea, eb)"), take("best", "Gross", "greatest(ea, eb) + CASE best WHEN 'A' THEN a_cost ELSE b_cost END"), "'Both options have identical risk-adjusted returns of $0.00'"],
        f"concat('Select Option A with a hedge of ', {dollars(d, 'CAST(floor(greatest(ea, eb) / 2) AS bigint)')})", {k: choice(d, n, k, v) for k, v in pay.items()}, {"ea": value("a"), "eb": value("b")}, {"best": "CASE WHEN ea > eb THEN 'A' ELSE 'B' END"},
    )


def claim(d):
    """What a long policy pays: the least of claim and the rider's sublimit, less its deductible. Wrong: the standard terms, no deductible, a denial."""
    n = "policy"
    pay = lambda x, s, limit: f"concat('Pay ', {dollars(d, x)}, ' under {s} with a sublimit of ', {dollars(d, limit)})"
    return question(
        d, n, f"concat('Section 2: limit ', {dollars(d, 'base')}, ', sublimit ', {dollars(d, 'base / 4')}, ', deductible ', {dollars(d, 'ded')}, '. Section 4: wear is excluded. Section 6 (rider, Tier-1 insured): sublimit ', {dollars(d, 'base / 2')}, ', deductible ', {dollars(d, 'ded / 2')}, '. Section 7: the rider prevails. Claim ', i, ': ', {dollars(d, 'claim')}, ', Tier-1 insured, maintained 42 days ago.')",
        pay("least(claim, base / 2) - ded / 2", "the rider", "base / 2"), [pay("least(claim, base / 4) - ded", "Section 2", "base / 4"), pay("least(claim, base / 2)", "the rider without deductible", "base / 2"), "'Deny the claim: a surge is wear under Section 4'"], "'Refer the claim back'",
        {"base": choice(d, n, "base", [500000, 1000000, 2000000]), "ded": choice(d, n, "ded", [25000, 50000]), "claim": choice(d, n, "claim", [350000, 450000, 750000])},
    )


for _name, _make in (("gen_sla_deadline", sla), ("gen_timezone_span", span), ("gen_tiered_pricing", pricing), ("gen_bayes", bayes), ("gen_emv", emv), ("gen_long_doc", claim)):
    sql(_name, _make)

# routing: a category by cumulative weights, a rule that does not apply as a distractor, four options at most
WEIGHTS = [("math", 20), ("coding", 20), ("document", 15), ("tools", 15), ("general", 15), ("coding_agent", 15)]
REQUESTS = {
    "math": ["Find the least common multiple of the two numbers.", "What is their greatest common divisor?"], "coding": ["Write a function that reverses a list; touch no files.", "Show a binary search in TypeScript."],
    "document": ["List the audit duties in the attached contract.", "Which notice period does the attached lease set?"], "tools": ["Move my meeting to Thursday in the calendar.", "File a ticket for the network team."],
    "general": ["Propose four names for a cache.", "Write an opening for a story under the sea."], "coding_agent": ["Fix the parser in the repository and run the tests.", "Upgrade the packages of the workspace and run the suite."],
}
RULES = [("Where changes must be tested in the repository, take coding_agent.", "coding_agent"), ("Where schemas are altered, take sql_agent.", "sql_agent"), ("For outside services take tools, not document.", "tools"), ("Code that changes no files is coding, not coding_agent.", "coding_agent"), ("For attached files take document.", "document")]


def routing(d):
    n, u, below = "route", "u", 0
    case = ""
    for name, w in WEIGHTS:
        below += w
        case += f" WHEN u < {below} THEN '{name}'"
    request = " ".join(f"WHEN '{k}' THEN {choice(d, n, 'text', v)}" for k, v in REQUESTS.items())
    base = layers(d, {"u": number(d, n, "weight", 0, 99), "rule": number(d, n, "rule", 0, len(RULES) - 1)}, {"target": f"CASE{case} END", "mentioned": d.pick([r[1] for r in RULES], "rule")}, {"premise": f"concat('Select the expert. ', {d.pick([r[0] for r in RULES], 'rule')}, ' Task: ', CASE target {request} END)"})
    names = " UNION ALL ".join(f"SELECT i, premise, target, {k} AS place, {x} AS name FROM base" for k, x in enumerate(("target", "mentioned", "'math'", "'coding'", "'tools'", "'general'")))
    return f"""WITH base AS (SELECT * FROM {base} AS b), named AS (SELECT i, premise, target, name, min(place) AS place FROM ({names}) AS u GROUP BY i, premise, target, name),
        kept AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY place) AS k FROM named)
        SELECT concat('route_', i, '_', name) AS id, concat('route_', i) AS group_id, premise, name AS option_, row_number() OVER (PARTITION BY i ORDER BY md5(concat(i, name))) - 1 AS slot, CASE WHEN name = target THEN 1 ELSE 0 END AS label FROM kept WHERE k <= 4"""


def yes_no(d, name, base, premise, valid):
    """Two options; right is yes where ``valid``."""
    return " UNION ALL ".join(f"SELECT concat('{name}_', i, '_{o}') AS id, concat('{name}_', i) AS group_id, {premise} AS premise, '{text}' AS option_, CASE WHEN {valid if o == 'yes' else f'NOT {valid}'} THEN 1 ELSE 0 END AS label FROM {base} AS {o}_rows" for o, text in (("yes", "yes: every condition is met"), ("no", "no: a condition is not met")))


def hard(d):
    """Worked answers, half of them with one flaw: a system of two equations, a tank, an area, a function."""
    n = "hard"
    off = choice(d, n, "off", [-4, -2, -1, 1, 2, 4])
    tank = "CAST(start AS double) - rate * hours + refill"
    base = layers(
        d, {"valid": f"{number(d, n, 'valid', 0, 1)} = 1", "kind": number(d, n, "kind", 0, 3), "std": number(d, n, "std", 70, 160), "acad": number(d, n, "acad", 40, 120), "rs": choice(d, n, "rs", [250, 300, 350, 400]), "ra": choice(d, n, "ra", [120, 150, 180, 200]),
            "start": number(d, n, "start", 150, 350), "rate": f"{choice(d, n, 'rate', [24, 35, 40, 52])} / 10e0", "hours": f"{choice(d, n, 'hours', [35, 40, 55, 60])} / 10e0", "refill": number(d, n, "refill", 40, 90), "yards": choice(d, n, "yards", [120, 240, 360, 480, 600])},
        {"text": f"""CASE kind WHEN 0 THEN concat('Passes at $', rs, ' and $', ra, ', ', std + acad, ' in all, earn $', std * rs + acad * ra, '. How many of the first? Answer: ', std + CASE WHEN valid THEN 0 ELSE {off} END)
            WHEN 1 THEN concat('A vat of ', start, ' l drains ', {d.tenths('rate')}, ' l/h for ', {d.tenths('hours')}, ' h, then gets ', refill, ' l. Answer: ', {d.tenths(f"round({tank}, 1) + CASE WHEN valid THEN 0e0 ELSE {choice(d, n, 'drift', [-30, -15, 15, 30])} / 10e0 END")})
            WHEN 2 THEN concat(yards, ' square yards in square metres. Answer: ', {d.tenths("round(yards * CASE WHEN valid THEN 0.836127e0 ELSE 0.9144e0 END, 1)")})
            ELSE concat('Split a list in parts of a size; refuse sizes under 1. Answer: ', CASE WHEN valid THEN 'checks the size, then slices' ELSE 'slices' END) END"""},
    )
    return yes_no(d, n, base, "concat('Is the answer right in all parts? ', text)", "valid")


POLICIES = [
    ("Free accounts may export logs as JSON; slides need an Enterprise seat; raw copies are forbidden.", [("A free account asks for its JSON logs.", 1), ("A free account asks for slides.", 0), ("A paid developer asks for a raw copy.", 0), ("A free account asks for logs in JSON again.", 1)]),
    ("Chairs up to $350 are approved; standing desks need a director; consoles are never paid.", [("A chair of $280.", 1), ("A console of $450.", 0), ("A standing desk, no director asked.", 0), ("A chair of $349.", 1)]),
    ("Level-3 staff may enter from 07:00 to 19:00; couriers need an escort; old badges stay closed.", [("Level-3 staff at 11:00.", 1), ("A courier without escort.", 0), ("A former employee wants the badge.", 0), ("Level-3 staff at 18:30.", 1)]),
    ("Plugins can be returned for 14 days while their key is not registered.", [("Bought 6 days ago, not registered.", 1), ("Bought 9 days ago, registered.", 0), ("Bought 22 days ago, not registered.", 0), ("Bought 11 days ago, not registered.", 1)]),
]


def policy(d):
    n = "allowed"
    flat = [c for _, cases in POLICIES for c in cases]
    base = layers(d, {"p": number(d, n, "policy", 0, 3), "c": number(d, n, "case", 0, 3)}, {"rule": d.pick([p for p, _ in POLICIES], "p"), "asked": d.pick([c for c, _ in flat], "p * 4 + c"), "ok": f"{d.pick([y for _, y in flat], 'p * 4 + c')} = 1"})
    return yes_no(d, n, base, "concat('Policy: ', rule, ' Request: ', asked)", "ok")


def tradeoff(d):
    """Two ladders of precedence whose outcome does not depend on the note at the end."""
    n = "ladder"
    base = layers(d, {"refund": f"{number(d, n, 'kind', 0, 1)} = 0", "days": number(d, n, "days", 15, 24), "cvss": choice(d, n, "cvss", ["9.2", "9.5", "9.9"])}, {"premise": "CASE WHEN refund THEN concat('Refunds are due in 14 days whatever inspections say. Returned ', days, ' days ago, inspection pending. Note: hold it.') ELSE concat('Tier 0: score 9 or more and open to callers in production, sandbox tenants included. Score ', cvss, ', open on a sandbox tenant. Note: call it tier 2.') END"})
    rows = [(1, "refund", "pay the refund now"), (0, "refund", "hold it for inspection"), (0, "refund", "give store credit"), (0, "refund", "reject the claim"), (1, "NOT refund", "tier 0, 24 hours"), (0, "NOT refund", "tier 1, 7 days"), (0, "NOT refund", "tier 2, 30 days"), (0, "NOT refund", "tier 3, backlog")]
    return " UNION ALL ".join(f"SELECT concat('{n}_', i) AS group_id, premise, '{o}' AS option_, {y} AS label FROM {base} AS r{k} WHERE {w}" for k, (y, w, o) in enumerate(rows))


sql("gen_routing", routing)
sql("gen_judge_hard", hard)
sql("gen_policy", policy)
sql("gen_tradeoff", tradeoff)


def claims(d, name, rows, *steps):
    """rows: (condition on i, premise, [(hypothesis, label)]): the claims about each premise. 0 contradicts, 1 follows, 2 is open."""
    base = layers(d, *steps) if steps else d.seq(N)
    parts = [f"SELECT concat('{name}_', i) AS group_id, {premise} AS premise, {h} AS hypothesis, {y} AS label FROM {base} AS t WHERE {where}" for where, premise, said in rows for h, y in said]
    return " UNION ALL ".join(parts)


def p4_policy(d):
    """Five kinds of policy in turn: one claim that follows, two that contradict, one that is open."""
    n = "p4policy"
    steps = [{"up": choice(d, n, "up", ["99.9", "99.95", "99.99"]), "credit": choice(d, n, "credit", [10, 15, 20]), "more": choice(d, n, "more", [30, 40, 50]), "days": choice(d, n, "days", [30, 45, 60]), "spend": f"{number(d, n, 'spend', 5, 50)} * 1000", "rps": choice(d, n, "rps", [100, 200, 500]), "burst": choice(d, n, "burst", [15, 30, 60])}]
    rows = [
        ("i % 5 = 0", "concat('Uptime under ', up, '% gives ', credit, '% credit, under 99.0% ', more, '%. Claims within ', days, ' days. Monthly fee: $', spend, '.')", [(f"concat('At 99.2% uptime the credit is ', {dollars(d, 'spend * credit / 100')}, '.')", 1), (f"concat('At 99.2% uptime the credit is ', {dollars(d, 'spend * more / 100')}, '.')", 0), ("concat('A claim after ', days + 10, ' days is in time.')", 0), ("'The provider runs its own power plant.'", 2)]),
        ("i % 5 = 1", "concat('Logs are kept ', days, ' days, then erased; a legal hold stops that.')", [("concat('Without a hold, logs of ', days + 1, ' days ago are gone.')", 1), ("'Logs under a legal hold are erased in time.'", 0), ("concat('Logs are kept ', days * 2, ' days at least.')", 0), ("'Logs are stored in Dublin.'", 2)]),
        ("i % 5 = 2", "concat('Trips of up to $', spend, ' need no approval; a higher fare needs one beforehand.')", [("concat('A fare of $', spend + 100, ' needs approval.')", 1), ("concat('A fare of $', spend - 100, ' needs approval.')", 0), ("'Approval can follow the trip.'", 0), ("'Most trips go by train.'", 2)]),
        ("i % 5 = 3", "concat('The supplier is liable up to $', spend, ', without limit for gross negligence.')", [("'Gross negligence has no ceiling.'", 1), ("concat('Gross negligence is capped at $', spend, '.')", 0), ("'The supplier is never liable.'", 0), ("'The supplier has offices in Lyon.'", 2)]),
        ("i % 5 = 4", "concat('Tenants get ', rps, ' requests a second, and bursts above it for ', burst, ' seconds; then they are throttled.')", [("concat('A burst of ', burst - 5, ' seconds is let through.')", 1), ("concat('A burst of ', burst + 5, ' seconds is let through.')", 0), ("'Tenants are banned after one burst.'", 0), ("'Usage is reported weekly.'", 2)]),
    ]
    return claims(d, n, rows, *steps)


def p4_numeric(d):
    """Four kinds in turn: storage in tiers, a notice date, a prepayment, throughput."""
    n = "p4num"
    gb = "tb * 1024"
    cost = f"CAST(round(100 * CASE WHEN {gb} <= 10240 THEN {gb} * 0.02e0 WHEN {gb} <= 61440 THEN 204.8e0 + ({gb} - 10240) * 0.015e0 ELSE 204.8e0 + 768 + ({gb} - 61440) * 0.01e0 END) AS bigint)"
    end = d.days("served", "notice")
    day = lambda x: f"substr(CAST({x} AS string), 1, 10)"
    steps = [
        {"tb": number(d, n, "tb", 40, 150), "month_": choice(d, n, "month", [1, 4, 7, 10]), "day_": number(d, n, "day", 10, 22), "notice": choice(d, n, "notice", [30, 45, 60]), "principal": f"{choice(d, n, 'principal', [100, 200, 300, 500])} * 1000", "interest": choice(d, n, "interest", [40, 50, 60, 75]), "penalty": choice(d, n, "penalty", [10, 15, 20]), "workers": choice(d, n, "workers", [16, 32, 64]), "p50": choice(d, n, "p50", [15, 20, 25])},
        {"served": "make_date(2026, month_, day_)"},
    ]
    rows = [
        ("i % 4 = 0", "'Storage: $0.020 a GB up to 10,240 GB, $0.015 for the next 51,200, $0.010 above.'", [(f"concat(tb, ' TB cost ', {money(d, cost)}, ' a month.')", 1), (f"concat(tb, ' TB cost ', {money(d, gb + ' * 2')}, ' a month.')", 0), ("concat(tb, ' TB are free if more is read than written.')", 0), ("'Copies are made every night.'", 2)]),
        ("i % 4 = 1", f"concat('Notice of ', notice, ' days, from the day after service; served on ', {day('served')}, '.')", [(f"concat('The lease ends on ', {day(end)}, '.')", 1), (f"concat('The lease ends on ', {day(d.days('served', 'notice + 10'))}, '.')", 0), ("'The tenant may leave on the day of service and owes nothing.'", 0), ("'The deposit is returned by cheque.'", 2)]),
        ("i % 4 = 2", "concat('Loan of $', principal, ' at ', interest / 10e0, '%; paid back before year 3 a penalty of ', penalty / 10e0, '% of the principal is due.')", [(f"concat('Paid back after 12 months, the penalty is ', {dollars(d, 'principal * penalty / 1000')}, '.')", 1), (f"concat('Paid back after 12 months, the penalty is ', {dollars(d, 'principal * interest / 1000')}, '.')", 0), ("'The penalty falls away if the loan moves to a sister company.'", 0), ("'The lender audits every year.'", 2)]),
        ("i % 4 = 3", "concat(workers, ' workers, median ', p50, ' ms; peak throughput is 1000 / median x workers.')", [(f"concat('The peak is about ', {d.commas('floor(1000 * workers / p50)')}, ' requests a second.')", 1), (f"concat('The peak is about ', {d.commas('floor(1000 * workers / (p50 * 3.5e0))')}, ' requests a second.')", 0), ("concat(workers * 4, ' workers give four times as much for sure.')", 0), ("'The test ran overnight.'", 2)]),
    ]
    return claims(d, n, rows, *steps)


def p4_hops(d):
    """Chains of three statements: the conclusion, a broken chain, an open claim."""
    n = "p4hop"
    steps = [{"country": choice(d, n, "country", ["Norway", "Estonia", "Singapore", "Canada"]), "often": choice(d, n, "often", ["biannual", "quarterly", "annual"]), "organ": choice(d, n, "organ", ["renal", "hepatic", "cardiac"]), "lib": choice(d, n, "lib", ["2.34", "2.36", "2.38"])}]
    rows = [
        ("i % 3 = 0", "concat('Firm ', i, ' works only in ', country, '. Firms in ', country, ' fall under the act. The act asks for ', often, ' audits.')", [("concat('Firm ', i, ' must have ', often, ' audits.')", 1), ("concat('Firm ', i, ' is exempt from the act.')", 0), ("concat('Firm ', i, ' has chosen its auditor.')", 2)]),
        ("i % 3 = 1", "concat('Drug ', i, ' blocks enzyme E', i % 12, '. Virus H', i % 8, ' needs that enzyme. Blocking it did no ', organ, ' harm.')", [("concat('Drug ', i, ' holds virus H', i % 8, ' back.')", 1), ("concat('Drug ', i, ' speeds enzyme E', i % 12, ' up.')", 0), ("concat('Drug ', i, ' costs $450.')", 2)]),
        ("i % 3 = 2", "concat('Package ', i, ' needs core 2.4. Core 2.4 links against C library ', lib, '. This system has another C library and no emulation.')", [("concat('Package ', i, ' does not link on this system.')", 1), ("concat('Package ', i, ' needs nothing else.')", 0), ("'Core 3 will be written in Rust.'", 2)]),
    ]
    return claims(d, n, rows, *steps)


OPEN = [
    ("The tumour shrank by 40% in 12 weeks of therapy.", "The therapy was followed by a smaller tumour.", "The tumour grew by 40%.", "The patient felt tired during the therapy."),
    ("The firm bought its rival for $120 million in cash in June.", "The rival was bought for cash.", "The purchase was called off.", "The rival's founder joins the board."),
    ("The run answered 10,000 queries in 14.8 ms on average.", "Ten thousand queries took under 20 ms each on average.", "The run crashed after 10 queries.", "The machine was cooled with water."),
    ("Flight 882 was diverted to Milwaukee by a storm.", "Flight 882 did not land where it was meant to.", "Flight 882 landed on time in Chicago.", "The passengers went on by coach."),
    ("The roof made 42.5 kWh on Wednesday and sold 18.2 of them.", "More than 15 kWh were sold.", "The roof made nothing on Wednesday.", "The owner saved $4.50."),
]
LADDERS = [
    ("Alpha: 12 ms, 84%. Beta: 185 ms, 92%. Gamma: 45 ms, 88%. Needed: under 20 ms; precision comes second.", "Alpha is right: it alone is under 20 ms.", "Beta is right: precision decides.", "Gamma is right: 45 ms are needed.", "Alpha will run in the cloud."),
    ("Key: no phishing, much effort. Code: some phishing. Password: much phishing. Needed: no phishing, whatever the effort.", "The key must be used.", "The code is right: effort decides.", "The password is right: it is cheapest.", "The officer signs all orders."),
    ("Screen 1: 3.8 W. Screen 2: 1.6 W. Screen 3: 0.2 W, slow. Needed: days without charging; speed does not matter.", "Screen 2 or 3 should be taken.", "Screen 1 is needed for its speed.", "Screen 1 needs less than screen 3.", "The case is waterproof."),
]


def fixed(d, name, table, labels):
    """The rows of a fixed table in turn, told apart by a record number."""
    return claims(d, name, [(f"i % {len(table)} = {k}", f"concat({literal(row[0])}, ' (Record ', lpad(CAST(i AS string), 4, '0'), ')')", [(literal(h), y) for h, y in zip(row[1:], labels)]) for k, row in enumerate(table)])


sql("gen_p4_long_policy", p4_policy)
sql("gen_p4_numeric", p4_numeric)
sql("gen_p4_multi_hop", p4_hops)
sql("gen_p4_ambiguous", lambda d: fixed(d, "p4open", OPEN, (1, 0, 2)))
sql("gen_p4_tradeoff", lambda d: fixed(d, "p4ladder", LADDERS, (1, 0, 0, 2)))

# modes: one drawn item, then a claim of each label about it
TOOLS = [("search", "Finds pages on the web.", ["Who won in 1998?", "Find papers on bees."], ["Turn the lights off.", "Delete my account."], ["Hello there.", "I am bored."]), ("calendar", "Makes and moves meetings.", ["Move my meeting to Friday.", "When am I free?"], ["Translate this.", "Sum these."], ["It is Monday.", "So much to do."]), ("mail", "Sends and reads mail.", ["Write to Ann.", "Any new mail?"], ["Draw a cat.", "Play a song."], ["Thanks.", "What now?"])]
SERVES = ["This request should be handled by: ", "The right tool is: ", "Route to: "]
RUBRICS = [("What boils at 100 degrees?", "Water", "Water does", "Iron does", "Boiling is fun"), ("Who wrote Faust?", "Goethe", "It was Goethe", "It was Kafka", "Faust is long"), ("How many legs has a spider?", "Eight", "8 legs", "Six legs", "Spiders spin")]
SEARCHES = [("how do magnets work", "Magnets work by aligned spins.", "Magnets work by glue.", "Magnets are sold in shops."), ("why is the sky blue", "Short waves scatter more.", "The sky mirrors paint.", "The sky was blue on Monday."), ("what is rust", "Iron that has met oxygen.", "A kind of wood.", "Rust is brown in paintings.")]
CLOZES = [("The capital of France is", "Paris", "Berlin", "a city by a river", "older than Rome"), ("Water is made of", "hydrogen and oxygen", "iron", "drops", "rain"), ("Bees make", "honey", "steel", "noise", "dances")]
STEMS = ["The correct answer is: ", "The blank is: ", "Answer: ", "It should read: ", "Fill in: ", "Completed by: ", "Best choice: ", "The text goes on: "]
CONTEXTS = [("The plant opened in 1998 and made 40 cars a day; output increased in 2020.", ["The plant made 40 cars a day.", "Output increased in 2020."], ["The plant opened in 1890.", "Output fell in 2020."], ["The plant is painted green.", "The cars were cheap."]), ("Acme bought the mill for $12 million; more than 60% of staff stayed.", ["Acme bought the mill.", "More than 60% of staff stayed."], ["The mill was a gift.", "All staff left."], ["The mill makes flour.", "Acme will buy more."])]
UNRELATED = ["Storm warnings are out for the coast.", "Resize the picture to 1024 pixels.", "Water repels all ions.", "The wire must go to account 98.", "The patient takes the pills twice a day."]


def tool_routing(d):
    """For each draw a request that fits, one that does not, one that is open; a fifth of the claims are negated, which turns the label."""
    n = "tool"
    q = lambda what: d.pick([x for t in TOOLS for x in t[what]], f"tool * 2 + {d.draw(key(n, f'q{what}'), 2)}")
    desc = d.pick([t[1] for t in TOOLS], "tool")
    steps = [{"tool": number(d, n, "tool", 0, 2), "turn1": f"{d.draw(key(n, 'turn1'), 5)} = 0", "turn0": f"{d.draw(key(n, 'turn0'), 5)} = 0"}, {"plain": f"concat({choice(d, n, 'serve', SERVES)}, {desc})", "negated": f"concat('This request should NOT be handled by: ', {desc})"}]
    return claims(d, n, [("true", f"concat('User request: ', {q(2)})", [("CASE WHEN turn1 THEN negated ELSE plain END", "CASE WHEN turn1 THEN 0 ELSE 1 END")]), ("true", f"concat('User request: ', {q(3)})", [("CASE WHEN turn0 THEN negated ELSE plain END", "CASE WHEN turn0 THEN 1 ELSE 0 END")]), ("true", f"concat('User request: ', {q(4)})", [("plain", 2)])], *steps)


def drawn(d, n, table, premise, claims_, *more):
    """claims_: (hypothesis, label) over the columns c0, c1 .. of a drawn row of the table."""
    columns = {f"c{k}": d.pick([row[k] for row in table], "row_") for k in range(len(table[0]))}
    return claims(d, n, [("true", premise, claims_)], {"row_": number(d, n, "row", 0, len(table) - 1)}, columns, *more)


sql("mode_tool_routing", tool_routing)
sql("mode_rubric", lambda d: drawn(d, "rubric", RUBRICS, "concat(c0, chr(10), 'Reference answer: ', c1)", [("concat('Candidate answer: ', c2)", 1), ("concat('Candidate answer: ', c3)", 0), ("concat('Candidate answer: ', c4)", 2)]))
sql("mode_search", lambda d: drawn(d, "search", SEARCHES, "c0", [("c1", 1), ("c2", 0), ("c3", 2)]))
sql("mode_cloze", lambda d: drawn(d, "cloze", CLOZES, "c0", [("concat(stem, c1)", 1), ("concat(stem, c2)", 0), (f"concat(stem, CASE WHEN {d.draw(key('cloze', 'open'), 2)} = 0 THEN c3 ELSE c4 END)", 2)], {"stem": choice(d, "cloze", "stem", STEMS)}))


def rag(d):
    n = "rag"
    said = lambda what: d.pick([x for c in CONTEXTS for x in c[what]], f"ctx * 2 + {d.draw(key(n, f'said{what}'), 2)}")
    return claims(d, n, [("true", d.pick([c[0] for c in CONTEXTS], "ctx"), [(said(1), 1), (said(2), 0), (said(3), 2)])], {"ctx": number(d, n, "ctx", 0, len(CONTEXTS) - 1)})


def abstention(d):
    """Two fifths with the right statement among the options, three tenths with none, the rest without options; equal pairs once."""
    n = "abstain"
    none = "'Option C: None of the above.'"
    listed = lambda a, b: f"concat('Document: ', ctx, chr(10), 'Option A: ', {a}, chr(10), 'Option B: ', {b}, chr(10), {none})"
    steps = [{"c": number(d, n, "ctx", 0, 1), "roll": number(d, n, "roll", 0, 99), "u": number(d, n, "u", 0, 4), "step": number(d, n, "step", 1, 4)}, {"ctx": d.pick([c[0] for c in CONTEXTS], "c"), "fact": d.pick([x for c in CONTEXTS for x in c[1]], f"c * 2 + {d.draw(key(n, 'fact'), 2)}"), "d1": d.pick(UNRELATED, "u"), "d2": d.pick(UNRELATED, "(u + step) % 5")}]
    rows = [
        ("roll < 40", listed("fact", "d1"), [("'The document supports Option A.'", 1), ("'The document supports Option C (none of the above).'", 0)]),
        ("roll >= 40 AND roll < 70", listed("d1", "d2"), [("'The document supports Option C (none of the above).'", 1), ("concat('The document supports Option A (', d1, ').')", 2)]),
        ("roll >= 70", "concat('Reference text: ', ctx)", [("d1", 2), ("concat('The reference text is enough to verify that: ', d1)", 0)]),
    ]
    return f"SELECT premise, hypothesis, min(label) AS label FROM ({claims(d, n, rows, *steps)}) AS all_ GROUP BY premise, hypothesis"


sql("mode_rag", rag)
sql("mode_abstention", abstention)
