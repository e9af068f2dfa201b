"""Equal and unequal expressions: named cases, and random ones against their values."""

import cmath
import math
import random

import pytest

from millrace.functions import algebra, math_answers, math_rewards

EQUAL = [
    ("x+1", "1+x"), ("(x+1)^2", "x^2+2x+1"), ("(x+y)(x-y)", "x^2-y^2"), ("sqrt(8)", "2sqrt(2)"), ("1/sqrt(2)", "sqrt(2)/2"), ("sqrt(12)+sqrt(27)", "5sqrt3"), ("1/(1+sqrt(2))", "sqrt(2)-1"), ("sqrt(3+2sqrt(2))", "1+sqrt(2)"),
    ("sqrt(4x)", "2sqrt(x)"), ("sqrt(-4)", "2sqrt(-1)"), ("(x^2-1)/(x-1)", "x+1"), ("2pi", "pi*2"), ("2^x", "2^x*1"), ("5!", "120"), ("((x+y+1)^9)^9", "((y+x+1)^9)^9"), ("((x+sqrt(2))^9)^9", "((sqrt(8)/2+x)^9)^9"), ("2^0.5", "sqrt(2)"),
    ("0.5", "1/2"), ("3(2)", "6"), ("2/3x", "2x/3"), ("--3", "3"), ("x^-1", "1/x"), ("sqrt(50)*sqrt(2)", "10"), ("sqrt(x)^2", "x"), ("x!", "x!"), ("10^6*3", "3000000"),
]
UNEQUAL = [
    ("x", "y"), ("sqrt(x^2)", "x"), ("x^2", "x^3"), ("1/0", "2"), ("((x+1)^9)^9", "((x+1)^9)^9+1"), ("-x^2", "(-x)^2"), ("sqrt(2)", "1.414"), ("1/3", "0.333"), ("sqrt(2)+sqrt(3)", "sqrt(5)"), ("pi", "3.14"), ("x", "x+"), ("", "1"), ("x=5", "5"), ("(1,2)", "1"),
    ("abc+1", "1+abc"), ("x^10", "x^10"), ("x^{2}", "x^2"), ("x^(2)", "x^2"), ("east", "east"), ("2^x", "3^x"), ("sqrt(-1)", "1"),
]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal(a, b):
    assert algebra.same_expression(a, b) is True and algebra.same_expression(b, a) is True


@pytest.mark.parametrize(("a", "b"), UNEQUAL)
def test_unequal(a, b):
    assert algebra.same_expression(a, b) is False and algebra.same_expression(b, a) is False


def test_unknown_functions_stay_open():
    assert algebra.same_expression("ln(4)", "2ln(2)") is None
    assert algebra.same_expression("ln(4)", "abcd") is False


def made(rng, depth):
    """A random expression as text for the reader and as a function of x and y."""
    if depth == 0 or rng.random() < 0.15:
        kind = rng.randrange(4)
        if kind == 0:
            n = rng.randint(0, 9)
            return str(n), lambda x, y: n
        if kind == 1:
            n = rng.choice([2, 3, 5, 8, 12, 18])
            return f"sqrt({n})", lambda x, y: math.sqrt(n)
        return ("x", lambda x, y: x) if kind == 2 else ("y", lambda x, y: y)
    (s, f), (t, g) = made(rng, depth - 1), made(rng, depth - 1)
    kind = rng.randrange(5)
    if kind == 0:
        return f"({s})+({t})", lambda x, y: f(x, y) + g(x, y)
    if kind == 1:
        return f"({s})-({t})", lambda x, y: f(x, y) - g(x, y)
    if kind == 2:
        return f"({s})({t})", lambda x, y: f(x, y) * g(x, y)
    if kind == 3:
        return f"({s})/(({t})+11)", lambda x, y: f(x, y) / (g(x, y) + 11)
    n = rng.randint(0, 3)
    return f"({s})^{n}", lambda x, y: f(x, y) ** n


@pytest.mark.parametrize("seed", range(4))
def test_random_expressions_against_values(seed):
    rng, seen = random.Random(seed), set()
    made_ones = [made(rng, 3) for _ in range(60)]
    for s, f in made_ones:
        t, g = rng.choice([*made_ones, (f"(({s})+1)^2", lambda x, y, f=f: (f(x, y) + 1) ** 2)])
        other = f"({s})^2+2({s})+1"
        assert algebra.same_expression(f"(({s})+1)^2", other) is True, s
        want = all(cmath.isclose(f(x, y), g(x, y), rel_tol=1e-9, abs_tol=1e-9) for x, y in ((0.3, 1.7), (2.1, 0.9), (1.3, 3.1)))
        assert algebra.same_expression(s, t) is want, (s, t)
        seen.add(want)
    assert False in seen


def test_graded_parts():
    assert math_rewards.graded("x+1", "1+x") is True
    assert math_rewards.graded("2/4", "1/2") is False
    assert math_rewards.graded("(x+1,2y)", "(1+x,y*2)") is True
    assert math_rewards.graded("(x+1,2y]", "(1+x,y*2)") is False
    assert math_rewards.graded("2.0x/2", "x") is True
    assert math_rewards.graded("sqrt(4)", "2") is False  # a whole number asks for a whole number
    assert math_rewards.graded("ln(9)", "2ln(3)") is None


def test_boxes():
    assert math_answers.last_box(r"first attempt \boxed{wrong}, final \boxed{42}") == r"\boxed{42}"
    assert math_answers.last_box(r"answer: \boxed{\frac{1}{2}}") == r"\boxed{\frac{1}{2}}"
    assert math_answers.last_box(r"answer: \fbox{7}") == r"\fbox{7}" and math_answers.last_boxed(r"answer: \fbox{7}") is None
    assert math_answers.last_box(r"\fbox{7} \boxed x and {y}") == r"\boxed x and {y}" and math_answers.last_boxed(r"\boxed x and {y}") is None
    assert math_answers.last_box("plain text, no box") is None and math_answers.last_box(None) is None
    assert math_answers.last_box(r"start \boxed{never closes") is None
    assert math_answers.last_boxed(r"\boxed{a} then \boxed x") is None
