"""The cue vocabulary that doesn't depend on labels, and the curated replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Entries by tag; `x*` stands for all identifiers that begin with x, `A.b` for A and b.

ATTRIBUTED = ["sleep", "wait", "Interrupted", "InterruptedException"]

API = [
    "Thread", "Thread.sleep", "await*", "Awaitility", "CountDownLatch", "Semaphore",
    "ExecutorService", "Executors", "Executor", "Future", "CompletableFuture", "synchronized",
    "volatile", "Concurrent*", "HashMap", "HashSet", "LinkedHashMap", "LinkedHashSet", "keySet",
    "entrySet", "values", "Random", "currentTimeMillis", "nanoTime", "TimeUnit", "Date",
    "Calendar", "LocalDateTime", "Instant", "now", "join", "submit", "execute", "invokeAll",
    "schedule", "ScheduledExecutorService", "AtomicInteger", "AtomicLong", "AtomicBoolean",
    "AtomicReference", "ReentrantLock", "CyclicBarrier", "Phaser", "ForkJoinPool", "sleep",
    "notify", "notifyAll", "System.currentTimeMillis", "System.nanoTime", "Instant.now",
    "listFiles", "toArray", "Runnable", "Callable", "runAsync", "supplyAsync", "thenApply",
]

CURATED = {
    "async_wait": ["await", "Awaitility", "timeout", "poll", "eventually", "assertEventually", "retry", "waitFor", "waitUntil", "delay"],
    "concurrency": ["Thread", "thread", "concurrent", "Concurrent", "lock", "Lock", "atomic", "Atomic", "race", "parallel", "Parallel"],
    "time": ["time", "Time", "clock", "Clock", "timestamp", "millis", "nanos", "Duration", "elapsed"],
    "unordered_collections": ["Hash", "hash", "unordered", "order", "sorted", "Sorted", "shuffle", "iterator", "Iterator"],
    "test_order_dependency": ["static", "setUp", "tearDown", "BeforeClass", "AfterClass", "FixMethodOrder", "MethodSorters", "shared", "reset", "clear"],
}

RENAMES = {
    "Thread": "Util", "sleep": "pause", "wait": "hold", "notify": "signal", "notifyAll": "signalAll",
    "Interrupted": "Halted", "InterruptedException": "HaltedFailure", "CountDownLatch": "Gate", "Semaphore": "Permit",
    "CyclicBarrier": "Ring", "Phaser": "Stager", "ReentrantLock": "Guard", "ExecutorService": "Runner",
    "ScheduledExecutorService": "TimedRunner", "Executors": "Runners", "Executor": "Dispatcher", "ForkJoinPool": "SplitPool",
    "Future": "Handle", "CompletableFuture": "ChainHandle", "runAsync": "startChain", "supplyAsync": "produceChain",
    "thenApply": "andMap", "submit": "post", "execute": "invokeOn", "invokeAll": "postAll", "schedule": "postLater",
    "join": "settle", "await": "stall", "Awaitility": "Stallity", "HashMap": "MapA", "LinkedHashMap": "MapB",
    "HashSet": "SetA", "LinkedHashSet": "SetB", "keySet": "firstView", "entrySet": "pairView", "values": "secondView",
    "toArray": "toBlock", "listFiles": "listEntries", "currentTimeMillis": "readCounter", "nanoTime": "readFineCounter",
    "now": "current", "Instant": "Mark", "LocalDateTime": "MarkLocal", "Date": "Stamp", "Calendar": "Almanac",
    "TimeUnit": "Scale", "Duration": "Span", "Random": "Picker", "AtomicInteger": "CellInt", "AtomicLong": "CellLong",
    "AtomicBoolean": "CellBool", "AtomicReference": "CellRef", "Runnable": "Job", "Callable": "Producer",
}

#: Tags in order of priority, each with its entries.
TAGS = {"attributed": ATTRIBUTED, "api": API, "attributed_curated": [e for entries in CURATED.values() for e in entries]}


def entries(spark: SparkSession) -> DataFrame:
    """(tag, priority, entry), as expand_entries() and disjoint_tags() take them."""
    rows = [(tag, k, entry) for k, (tag, own) in enumerate(TAGS.items()) for entry in own]
    return spark.createDataFrame(rows, "tag string, priority int, entry string")
