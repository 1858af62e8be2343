"""Keyed state asks the engine no more than it needs: every call is a message out of the worker and back."""

from pyspark.sql import Row

from mnemoloom.streaming import stateful as sf


class Engine:
    """Stands for a key's state and timers, and notes what is asked of them."""

    def __init__(self):
        self.held, self.timers, self.calls = None, set(), []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "getValueState":
                return self
            if name == "exists":
                return self.held is not None
            if name == "update":
                self.held = args[0]
            if name == "clear":
                self.held = None
            if name == "registerTimer":
                self.timers.add(args[0])
            if name == "deleteTimer":
                self.timers.remove(args[0])
            return self.held if name == "get" else iter(sorted(self.timers)) if name == "listTimers" else None

        return call


def test_timers_only_move_with_the_last_event():
    engine, jobs = Engine(), sf.Jobs("1 day")
    jobs.init(engine)
    day = 86_400_000
    asked = []
    for ms, seq in ((0, 1), (5000, 9), (3000, 4), (9000, 5)):  # the first at the epoch itself
        engine.calls.clear()
        told = list(jobs.handleInputRows((7,), iter([Row(job=7, step="build", seq=seq, state=f"s{seq}", ms=ms)]), None))
        asked.append(list(engine.calls))
    move = ["get", "update", "deleteTimer", "registerTimer"]
    assert asked == [["get", "update", "registerTimer"], move, ["get", "update"], move]
    assert engine.timers == {9000 + day}
    assert told == [Row(job=7, step="build", state="s9", updates=4, ended=False)]
    assert list(jobs.handleExpiredTimer((7,), None, None)) == [Row(job=7, step="build", state="s9", updates=4, ended=True)] and engine.held is None
