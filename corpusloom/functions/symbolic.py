"""Whether two mathematical answers denote the same expression.

Answers are untrusted model output, so nothing is evaluated as code: a small reader
turns LaTeX or plain notation into a postfix program, and programs are compared by their
values. Work is bounded by the number of tokens and the size of exponents instead of
by a clock: what exceeds a bound isn't read and equals nothing.
"""

from __future__ import annotations

import cmath
import math
import random
import re
from fractions import Fraction

TOKENS = 2000
DEPTH = 60
EXPONENT = 1 << 20
#: A Mersenne prime: rational functions that agree at random points modulo it are the same.
PRIME = (1 << 61) - 1
POINTS = 4
#: Relative tolerance between constants, and between values of expressions with roots and functions.
CONSTANT, EXACT = 1e-4, 1e-9

#: Functions of one argument, constants, and commands that only space or size.
FUNCTIONS = {
    "sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda z: 1 / cmath.tan(z), "sec": lambda z: 1 / cmath.cos(z),
    "csc": lambda z: 1 / cmath.sin(z), "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "asin": cmath.asin, "acos": cmath.acos,
    "atan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "log": cmath.log, "ln": cmath.log, "exp": cmath.exp, "abs": abs,
}
CONSTANTS = {"pi": math.pi, "E": math.e, "I": 1j}
IGNORED = {"left", "right", "displaystyle", "limits", "big", "Big", "bigl", "bigr", "quad", ",", ";", ":", "!", " "}
_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\d+(?:\.\d+)?|\.\d+|[A-Za-z]+|\*\*|[-+*/^_(){}\[\]|!·×÷−√π]")


class Unreadable(ValueError):
    pass


class Reader:
    """Precedence climbing over the tokens; ``program`` is postfix: numbers, names and operators."""

    def __init__(self, text: str):
        self.latex = bool(re.search(r"[\\{}]", text))
        self.at, self.depth, self.symbols = 0, 0, set()
        self.tokens = self._tokens(text)
        self.program: list[tuple] = []
        self.rational = True
        self.sum()
        if self.at < len(self.tokens):
            raise Unreadable("something follows the expression")

    def _tokens(self, text: str) -> list[str]:
        out: list[str] = []
        plain = {"·": "*", "×": "*", "÷": "/", "−": "-", "**": "^", "√": "\\sqrt", "π": "\\pi", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\{": "(", "\\}": ")"}
        end = 0
        for m in _TOKEN.finditer(text):
            if text[end : m.start()].strip():
                raise Unreadable("a character that has no meaning")
            end, t = m.end(), plain.get(m[0], m[0])
            if t[0] == "\\" and t[1:] in IGNORED:
                continue
            if t.isalpha() and t not in FUNCTIONS and t not in CONSTANTS and self.latex:
                out += t
            else:
                out.append("\\frac" if t in ("\\dfrac", "\\tfrac", "\\cfrac") else t)
        if text[end:].strip() or not out or len(out) > TOKENS:
            raise Unreadable("empty, too long, or a character that has no meaning")
        return out

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *expected: str) -> str:
        t = self.peek()
        if expected and t not in expected:
            raise Unreadable(f"{expected} expected")
        self.at += 1
        return t

    def emit(self, *step) -> None:
        self.program.append(step)

    def sum(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Unreadable("too deep")
        self.product()
        while self.peek() in ("+", "-"):
            sign = self.take()
            self.product()
            self.emit("neg") if sign == "-" else None
            self.emit("+")
        self.depth -= 1

    def product(self) -> None:
        self.signed()
        while t := self.peek():
            if t in ("*", "/"):
                self.take()
                self.signed()
                self.emit(t)
            elif t in ("+", "-", ")", "}", "]", "|", "^", "_", "!"):
                return
            else:
                self.power()  # juxtaposition
                self.emit("*")

    def signed(self) -> None:
        minus = False
        while self.peek() in ("+", "-"):
            minus ^= self.take() == "-"
        self.power()
        if minus:
            self.emit("neg")

    def power(self) -> None:
        self.atom()
        while self.peek() == "!":
            self.take()
            self.emit("!")
            self.rational = False
        if self.peek() == "^":
            self.exponent()

    def exponent(self) -> None:
        self.take("^")
        self.depth += 1
        if self.depth > DEPTH:
            raise Unreadable("too deep")
        start = len(self.program)
        if self.peek() == "{":
            self.group()
        else:
            minus = self.peek() == "-" and bool(self.take())
            self.power()
            self.emit("neg") if minus else None
        self.depth -= 1
        power = constant(self.program[start:])
        if power is not None and power.denominator == 1:
            if abs(power) > EXPONENT:
                raise Unreadable("an exponent too large")
            del self.program[start:]
            self.emit("**", int(power))
        else:
            self.rational = False
            self.emit("^")

    def group(self) -> None:
        close = {"(": ")", "{": "}", "[": "]", "|": "|"}[self.take("(", "{", "[", "|")]
        self.sum()
        self.take(close)

    def argument(self) -> None:
        """A braced group or a single token."""
        if self.peek() == "{":
            self.group()
        else:
            t = self.take()
            if re.fullmatch(r"\d+", t) and len(t) > 1:  # \frac12 takes one digit
                self.tokens[self.at - 1 : self.at] = [t[0], t[1:]]
                t = t[0]
            self.at -= 1
            self.atom()

    def atom(self) -> None:
        t = self.peek()
        if t in ("(", "{", "[", "|"):
            self.group()
            if t == "|":
                self.rational = False
                self.emit("abs")
            return
        self.take()
        if re.fullmatch(r"[\d.]+", t):
            self.emit("n", Fraction(t))
        elif t == "\\frac":
            self.argument()
            self.argument()
            self.emit("/")
        elif t in ("\\binom", "\\dbinom", "\\tbinom"):
            self.argument()
            self.argument()
            self.rational = False
            self.emit("binom")
        elif t.lstrip("\\") in FUNCTIONS:
            self.function(t.lstrip("\\"))
        elif t.lstrip("\\") in CONSTANTS:
            self.rational = False
            self.emit("c", t.lstrip("\\"))
        elif t.isalpha() or (t[:1] == "\\" and t[1:].isalpha()):
            if t in ("\\infty", "\\text", "\\begin", "\\end", "\\in", "\\cup", "\\pm"):
                raise Unreadable("not a value")
            if self.peek() == "_":
                self.take()
                t += "_" + "".join(self.index())
            self.symbols.add(t)
            self.emit("s", t)
        else:
            raise Unreadable("a value is expected")

    def index(self) -> list[str]:
        if self.peek() != "{":
            return [self.take()]
        self.take()
        out = []
        while self.peek() not in ("}", ""):
            out.append(self.take())
        self.take("}")
        return out

    def function(self, name: str) -> None:
        self.rational = False
        base = None
        if name == "sqrt" and self.peek() == "[":  # an n-th root
            self.group()
            self.emit("n", Fraction(-1))
            self.emit("^")
            degree = self.program[:]
            self.argument()
            radicand = self.program[len(degree) :]
            del self.program[self._start(degree) :]
            self.program += radicand + degree[self._start(degree) :]
            self.emit("^")
            return
        if name == "log" and self.peek() == "_":
            self.take()
            start = len(self.program)
            self.argument()
            self.emit("f", "log")
            base = self.program[start:]
            del self.program[start:]
        raised = None
        if self.peek() == "^":  # sin^2 x
            start = len(self.program)
            self.emit("n", Fraction(1))
            self.exponent()
            raised = self.program[start + 1 :]
            del self.program[start:]
        if self.peek() in ("(", "{", "[", "|"):
            self.atom()
        else:
            self.power()
            while self.peek() and (self.peek()[0] == "\\" and self.peek().lstrip("\\") in CONSTANTS or self.peek().isalpha() and self.peek() not in FUNCTIONS):
                self.power()
                self.emit("*")
        self.emit("f", name)
        if base:
            self.program += base
            self.emit("/")
        self.program += raised or []

    @staticmethod
    def _start(program: list[tuple]) -> int:
        """Where the last operand of a postfix program begins."""
        need, at = 1, len(program)
        while need:
            at -= 1
            step = program[at][0]
            need += {"n": -1, "c": -1, "s": -1, "neg": 0, "**": 0, "f": 0, "!": 0, "abs": 0}.get(step, 1)
        return at


def constant(program: list[tuple]) -> Fraction | None:
    """Exact value of a small program without names, roots or functions; null for others."""
    stack: list[Fraction] = []
    for op, *value in program:
        if op == "n":
            stack.append(value[0])
        elif op == "neg":
            stack.append(-stack.pop())
        elif op == "**":
            x = stack.pop()
            if (not x and value[0] < 0) or abs(value[0]) * max(x.numerator.bit_length(), x.denominator.bit_length()) > 4096:
                return None
            stack.append(x ** value[0])
        elif op in ("+", "*", "/"):
            y, x = stack.pop(), stack.pop()
            if op == "/" and not y:
                return None
            stack.append(x + y if op == "+" else x * y if op == "*" else x / y)
            if stack[-1].numerator.bit_length() + stack[-1].denominator.bit_length() > 4096:
                return None
        else:
            return None
    return stack[0]


def modular(program: list[tuple], point: dict[str, int]) -> int | None:
    """Value modulo the prime at a point; null where a divisor is zero."""
    stack: list[int] = []
    for op, *value in program:
        if op == "n":
            stack.append(value[0].numerator * pow(value[0].denominator, -1, PRIME) % PRIME)
        elif op == "s":
            stack.append(point[value[0]])
        elif op == "neg":
            stack.append(-stack.pop() % PRIME)
        elif op == "**":
            x = stack.pop()
            if not x and value[0] < 0:
                return None
            stack.append(pow(x, value[0], PRIME))
        else:
            y, x = stack.pop(), stack.pop()
            if op == "/" and not y:
                return None
            stack.append((x + y if op == "+" else x * y if op == "*" else x * pow(y, -1, PRIME)) % PRIME)
    return stack[0]


def numeric(program: list[tuple], point: dict[str, complex]) -> complex | None:
    """Value in double precision at a complex point; null where there is none."""
    stack: list[complex] = []
    try:
        for op, *value in program:
            if op == "n":
                stack.append(complex(value[0]))
            elif op == "s":
                stack.append(point[value[0]])
            elif op == "c":
                stack.append(complex(CONSTANTS[value[0]]))
            elif op == "neg":
                stack.append(-stack.pop())
            elif op == "f":
                stack.append(complex(FUNCTIONS[value[0]](stack.pop())))
            elif op == "abs":
                stack.append(complex(abs(stack.pop())))
            elif op == "!":
                x = stack.pop()
                if x.imag or x.real < 0 or x.real != int(x.real) or x.real > 170:
                    return None
                stack.append(complex(math.factorial(int(x.real))))
            elif op == "**":
                stack.append(stack.pop() ** value[0])
            else:
                y, x = stack.pop(), stack.pop()
                if op == "binom":
                    if x.imag or y.imag or not (0 <= y.real == int(y.real) and 0 <= x.real == int(x.real) <= 1000):
                        return None
                    stack.append(complex(math.comb(int(x.real), int(y.real))))
                else:
                    stack.append(x + y if op == "+" else x * y if op == "*" else x / y if op == "/" else x**y)
    except (ArithmeticError, ValueError, OverflowError):
        return None
    return stack[0] if cmath.isfinite(stack[0]) else None


def equal(a: str, b: str, tolerance: float = CONSTANT) -> bool:
    """Whether two answers are the same expression, or constants within a relative tolerance.

    Rational functions are compared exactly, at random points of a prime field. Those with
    roots, functions or other exponents are compared in double precision at random complex
    points, so that an identity must hold for all signs. Relations, sets, infinity and unreadable
    or oversized answers equal nothing here.
    """
    try:
        x, y = Reader(a), Reader(b)
    except (Unreadable, RecursionError):
        return False
    names = sorted(x.symbols | y.symbols)
    rng = random.Random(61)
    if x.rational and y.rational:
        same = 0
        for _ in range(4 * POINTS):
            point = {s: rng.randrange(1, PRIME) for s in names}
            values = modular(x.program, point), modular(y.program, point)
            if None in values:
                continue
            if values[0] != values[1]:
                break
            same += 1
            if same == POINTS:
                return True
        if names:
            return False
    same = 0
    for _ in range(4 * POINTS):
        point = {s: complex(rng.uniform(-2, 2), rng.uniform(-2, 2)) for s in names}
        u, v = numeric(x.program, point), numeric(y.program, point)
        if u is None or v is None:
            if not names:
                return False
            continue
        if abs(u - v) > (EXACT if names else tolerance) * max(abs(u), abs(v), 1e-300):
            return False
        same += 1
        if same == POINTS:
            return True
    return False
