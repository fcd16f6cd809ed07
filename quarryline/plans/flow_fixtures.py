"""A small program in two files for the rules that need several functions, and what they find there."""

from __future__ import annotations

APP = """\
import requests

def find_user(key):
    return None

def load_user(key):
    return find_user(key)

def greet(key):
    user = load_user(key)
    return user.name

def greet_checked(key):
    user = load_user(key)
    if user is None:
        return ""
    return user.name

def open_log(path):
    handle = open(path)
    use_log(handle)

def use_log(handle):
    return handle

def parse(line):
    if not line:
        raise ValueError(line)
    return line

def read_all(path):
    source = open(path)
    rows = parse(path)
    source.close()
    return rows

def guarded(path):
    with open(path) as source:
        return parse(path)

def search(request):
    term = request.args["q"]
    return run_search(term)

def run_search(term):
    return query_rows(term)

def query_rows(term):
    return db.execute(term)

def search_safely(request):
    term = escape(request.args["q"])
    return run_search(term)

@app.route("/check")
def check(line):
    return step_one(line)

def step_one(line):
    return strict(line)

def strict(line):
    raise TypeError(line)

def hold(line):
    lock.acquire()
    parse(line)
    lock.release()

class Shop:
    @app.post("/orders")
    def create_order(self, order):
        self.keep(order)
        self.keep_lines(order)
        self.notify(order)

    def keep(self, order):
        repo.save(order)
        self.total = order.total

    def keep_lines(self, order):
        for line in order.lines:
            repo.insert_line(line)
            db.execute(line)

    def notify(self, order):
        requests.post(MAIL, order)
        requests.post(CHAT, order)
        self.charge(order)

    def charge(self, order):
        try:
            requests.post(BANK, order.payment)
            show(order.payment)
        except Exception:
            self.after(self.total)

    def after(self, total):
        self.last(total)

    def last(self, total):
        logger.info(total)

def show(payment):
    logger.info(payment)
"""
SERVICE = """\
package svc

func store(x int) error {
\treturn write(x)
}

func write(x int) error {
\treturn nil
}

func Run(x int) {
\tstore(x)
}

func RunChecked(x int) error {
\terr := store(x)
\treturn err
}
"""
FILES = [("app.py", "python", APP), ("svc.go", "go", SERVICE)]

# rule, function, line
CROSS = [
    ("NULL-PROP-UNCHECKED", "app.py::greet", 10),
    ("RESOURCE-NEVER-CLOSED-XFUNC", "app.py::open_log", 19),
    ("RESOURCE-LEAK-ON-EXCEPTION", "app.py::read_all", 33),
    ("TAINT-CROSS-FUNCTION", "app.py::search", 41),
    ("UNCAUGHT-EXCEPTION-PROPAGATION", "app.py::strict", 62),
    ("LOCK-LEAKED-ON-CALLEE-THROW", "app.py::hold", 67),
    ("ERROR-RETURN-IGNORED", "svc.go::Run", 12),
]
FLOWS = [
    ("BIZ-NO-TRANSACTION-BOUNDARY", "app.py::Shop.create_order", 71),
    ("BIZ-CASCADING-TIMEOUT", "app.py::Shop.create_order", 71),
    ("BIZ-SENSITIVE-NO-AUDIT", "app.py::Shop.create_order", 71),
    ("BIZ-MULTI-ENTRY-NO-AUTH", "app.py::Shop.create_order", 71),
    ("BIZ-NOT-IDEMPOTENT", "app.py::Shop.create_order", 71),
    ("BIZ-READ-WRITE-NO-LOCK", "app.py::Shop.create_order", 71),
    ("BIZ-ERROR-SWALLOWED-MIDFLOW", "app.py::Shop.charge", 91),
    ("BIZ-IO-IN-LOOP", "app.py::Shop.keep_lines", 84),
    ("BIZ-SENSITIVE-DATA-LEAK", "app.py::Shop.charge", 91),
    ("BIZ-SENSITIVE-DATA-LEAK", "app.py::show", 104),
]
