"""Rules over time as plain state machines: first() is the state of a new key, step() takes it on.

The batch operators and the streaming ones run the same rules. States hold what JSON can hold."""

from __future__ import annotations


class Throttle:
    """Leading edge: a call passes if `interval` has gone by since the last that passed."""

    def __init__(self, interval: int):
        self.interval = interval

    def first(self):
        return None

    def step(self, last, now: int):
        ok = last is None or now - last >= self.interval
        return ok, now if ok else last


class SlidingWindow:
    """A call passes if fewer than `limit` passed in (now - window, now]; refused ones don't count."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def first(self):
        return []

    def step(self, past: list, now: int):
        while past and past[0] <= now - self.window:
            past.pop(0)
        ok = len(past) < self.limit
        if ok:
            past.append(now)
        return ok, past


class TokenBucket:
    """A call passes if `cost` tokens are there; a bucket holds `burst`, starts full and gains `rate` a second."""

    def __init__(self, rate: float, burst: int, cost: int = 1):
        self.rate, self.burst, self.cost = rate, burst, cost

    def first(self):
        return [float(self.burst), None]

    def step(self, state: list, now: int):
        tokens, last = state
        gained = 0.0 if last is None else max(now - last, 0) / 1_000_000.0 * self.rate
        have = min(float(self.burst), tokens + gained)
        ok = have >= self.cost
        return ok, [have - self.cost, now] if ok else state


class Sometimes:
    """The first call, the first `first`, every `every`-th, and any once `interval` has gone by since the last that ran."""

    def __init__(self, first: int = 0, every: int = 0, interval: int = 0):
        self.most, self.every, self.interval = first, every, interval

    def first(self):
        return [0, None]

    def step(self, state: list, now: int):
        count, last = state
        ok = count == 0 or 0 <= count < self.most or (self.every > 0 and count % self.every == 0) or (self.interval > 0 and now - last >= self.interval)
        return ok, [count + 1, now if ok else last]


class Breaker:
    """A circuit breaker; step() takes (now, failed) and gives (admitted, state's name) and the state.

    Closed: calls run, and after each the share of failures of the trailing window (its older edge included) is
    judged; with `least` calls and a share of `threshold` it opens. Open: calls are refused until more than `cooldown`
    has gone by, then one probe runs; its success closes the breaker with an empty history, its failure opens it again."""

    def __init__(self, window: int, least: int, threshold: float, cooldown: int):
        self.window, self.least, self.threshold, self.cooldown = window, least, threshold, cooldown

    def first(self):
        return [None, [], 0]

    def step(self, state: list, call: tuple[int, bool]):
        (opened, past, bad), (now, failed) = state, call
        if opened is not None:
            if now - opened <= self.cooldown:
                return (False, "open"), state
            return (True, "open" if failed else "closed"), [now if failed else None, [], 0]
        past.append((now, failed))
        bad += failed
        gone = 0
        while past[gone][0] < now - self.window:
            bad -= past[gone][1]
            gone += 1
        del past[:gone]
        if len(past) >= self.least and bad / len(past) >= self.threshold:
            return (True, "open"), [now, [], 0]
        return (True, "closed"), [None, past, bad]


class Adaptive:
    """A concurrency limit that follows round-trip times; step() takes (now, rtt) and gives (limit,) and the state.

    The queue is guessed as limit * (1 - least rtt / smoothed rtt): above 5 the limit falls by 1, to 1 at least; below 2
    it grows by 1, to `most`. The smoothed time keeps 0.9 of itself, in whole units; the least one is forgotten once
    more than `forget` has gone by since the key's first row or the last time that was done. A time of 0 or less, or null, changes nothing."""

    def __init__(self, initial: int, most: int = 1000, forget: int = 30_000_000):
        self.initial, self.most, self.forget = float(initial), float(most), forget

    def first(self):
        return [self.initial, 0, 0, None]

    def step(self, state: list, call: tuple[int, int | None]):
        (limit, smooth, least, since), (now, rtt) = state, call
        since = now if since is None else since
        if rtt is None or rtt <= 0:
            return (limit,), [limit, smooth, least, since]
        if now - since > self.forget:
            least, since = 0, now
        least = rtt if least == 0 else min(least, rtt)
        smooth = rtt if smooth <= 0 else int(0.9 * smooth + 0.1 * rtt)
        queue = limit * (1.0 - least / smooth) if smooth else 0.0
        if queue > 5.0:
            limit = max(1.0, limit - 1.0)
        elif queue < 2.0:
            limit = min(self.most, limit + 1.0)
        return (limit,), [limit, smooth, least, since]


class OneOpen:
    """At most one open call an id; step() takes (now, the time of its answer or null) and gives (accepted,) and the state.

    A call is open up to its answer, that instant included, or until `timeout` has gone by; kept alive, for ever."""

    def __init__(self, timeout: int, keep_alive: bool = False):
        self.timeout, self.keep_alive = timeout, keep_alive

    def first(self):
        return None

    def step(self, free, call: tuple[int, int | None]):
        now, answered = call
        if free is not None and (self.keep_alive or now < free):
            return (False,), free
        return (True,), now + self.timeout if answered is None else answered + 1
