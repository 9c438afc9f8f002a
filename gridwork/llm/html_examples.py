"""A bounded, labelled set of web pages for the block classifier, generated from rules.

Pages mix semantic elements, elements named by class, id or role, and plain
div elements that say nothing. Words of the article begin with ``c``, all others
with ``b``, so a block's first letter is its label.
"""

from __future__ import annotations

import random


def page(r: random.Random, words: dict[str, list[str]]) -> str:
    """One page; ``words`` has the vocabulary of class names by group."""

    def some(mark: str, least: int, most: int, end: str = "") -> str:
        return " ".join(mark + "x" * r.randrange(1, 9) for _ in range(r.randrange(least, most))) + end

    def called(group: str) -> str:
        name = r.choice(words[group])
        name = r.choice([name, f"{name}-{r.randrange(9)}", f"site-{name}", f"{name}_box", name.capitalize(), f"x {name}"])
        return f' {r.choice(["class", "class", "id", "role"])}="{name}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/">{some("b", 1, 4)}</a></li>' for _ in range(n))

    def menu() -> str:
        inside = f"<ul>{links(r.randrange(2, 8))}</ul>"
        return r.choice([f"<nav>{inside}</nav>", f"<div{called('nav')}>{inside}</div>", f"<nav{called('nav')}>{inside}</nav>", f"<ul>{links(4)}</ul>", f"<header>{inside}</header>", f"<menu>{links(3)}</menu>"])

    def aside() -> str:
        text = r.choice([f"<p>{some('b', 3, 30, '.')}</p>", f"<h3>{some('b', 1, 4)}</h3><ul>{links(3)}</ul>", some("b", 2, 14), f"<p>{some('b', 2, 9)}</p><p>{some('b', 2, 20, '.')}</p>", f"<td>{some('b', 1, 5)}</td>"])
        return r.choice([f"<aside>{text}</aside>", *(f"<div{called(g)}>{text}</div>" for g in ("ads", "notice", "social", "nav", "ads")), f"<section{called('ads')}>{text}</section>", f"<p{called('ads')}>{some('b', 3, 20, '.')}</p>", f"<form>{text}<button>{some('b', 1, 3)}</button></form>", f"<form><fieldset>{text}</fieldset></form>", f"<dialog>{text}</dialog>", f"<div>{some('b', 1, 4)}</div>"])

    def talk() -> str:
        one = lambda: f"<p>{some('b', 3, 40, '.')}</p>"
        return r.choice([f"<div{called('comment')}>{one()}{one()}</div>", f"<section{called('comment')}><h3>{some('b', 1, 3)}</h3><ol><li>{one()}</li><li>{one()}</li></ol></section>", f"<ul{called('comment')}><li>{one()}</li></ul>"])

    def body() -> str:
        parts = [f"<h1>{some('c', 2, 9)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randrange(2, 9)):
            parts.append(r.choice([
                f"<p>{some('c', 6, 80, '.')}</p>", f"<p>{some('c', 6, 80, '.')}</p>", f"<p>{some('c', 1, 5, r.choice(['.', '']))}</p>", f"<h2>{some('c', 1, 6)}</h2>", f"<ul><li>{some('c', 1, 9)}</li><li>{some('c', 1, 9)}</li></ul>",
                f"<blockquote>{some('c', 4, 30, '.')}</blockquote>", f"<div>{some('c', 1, 40, '.')}</div>", f"<p><a href='/'>{some('c', 1, 3)}</a> {some('c', 3, 30, '.')}</p>", f"<pre>{some('c', 3, 20)}</pre>", f"<table><tr><td>{some('c', 1, 4)}</td><td>{some('c', 1, 4)}</td></tr></table>",
                f"<p><a href='/'>{some('c', 1, 4)}</a></p>", f"<figure><figcaption>{some('c', 2, 9)}</figcaption></figure>"]))
            if r.random() < 0.12:
                parts.append(aside())
        return "".join(parts)

    def article() -> str:
        inside = body() + (talk() if r.random() < 0.2 else "")
        return r.choice([f"<article>{inside}</article>", f"<article{called('content')}>{inside}</article>", f"<main>{inside}</main>", f"<div{called('content')}>{inside}</div>", f"<div{called('content')}><div>{inside}</div></div>", f"<main><article>{inside}</article></main>", f"<div><div>{inside}</div></div>", f"<section>{inside}</section>"])

    top = [menu()] + [r.choice([f"<header><p>{some('b', 1, 8)}</p></header>", f"<div{called('head')}>{some('b', 1, 8)}</div>", aside()]) for _ in range(r.randrange(3))]
    below = [f for f in (aside(), aside(), talk()) if r.random() < 0.5]
    foot = r.choice([f"<footer>{some('b', 2, 25, r.choice(['.', '']))}</footer>", f"<footer><p>{some('b', 2, 12)}</p><ul>{links(3)}</ul></footer>", f"<div{called('head')}>{some('b', 2, 20, '.')}</div>", f"<footer><address>{some('b', 2, 12)}</address></footer>", f"<address>{some('b', 2, 12)}</address>"])
    return f"<html><body>{''.join(top)}{article()}{''.join(below)}{foot}</body></html>"


def pages(n: int, seed: int, words: dict[str, list[str]]) -> list[str]:
    r = random.Random(seed)
    return [page(r, words) for _ in range(n)]
