"""Pages written by hand, of kinds that the training pages' generator does not make."""

import random

import numpy as np
import pytest

from veridelta.llm import html_text

STORY = [
    "The river rose in the night, and by the morning the lower fields were under water.",
    "Farmers moved their cattle to the hills before dawn, helped by neighbours with trucks.",
    "No one was hurt, the mayor said, but two bridges will stay closed for repairs.",
    "Engineers will inspect the dam on Friday; until then the road is open to residents only.",
    "Schools reopened on Tuesday after volunteers cleared mud from the main hall.",
    "A relief fund has been set up by the parish and accepts donations at the town hall.",
]
ALIKE = [f"This is paragraph number {i} of a rather ordinary page about nothing in particular." for i in range(8)]
MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav>"
PAGES = {
    "bare body": "<html><body>{}</body></html>",
    "no body": "{}",
    "a name that says nothing": "<body><div class=k9>{}</div></body>",
    "names of several kinds": "<body><article class='post tag-top-social'>{}</article></body>",
    "article": f"<body>{MENU}<article>{{}}</article><footer>Copyright</footer></body>",
    "boxes by name": "<body><div class=header>My site</div><div class=content>{}</div><div class=sidebar><h3>Popular</h3><ul><li><a href=x>one</a></ul></div></body>",
    "loose between menu and footer": f"<body>{MENU}{{}}<footer>Copyright by me</footer></body>",
    "comments by name": "<body><main>{}</main><div id=comments><p>Great article, thanks!</p></div></body>",
    "boxes without names": "<body><div><div>{}</div></div><div><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div></body>",
    "hidden parts": "<body><script>if (a < b) c('</p>')</script><style>p{{}}</style><form><label>Your name</label><input></form><section>{}</section></body>",
}


@pytest.mark.parametrize("name", PAGES)
@pytest.mark.parametrize("story", [STORY, ALIKE], ids=["varied", "alike"])
def test_the_text_is_whole_and_alone(name, story):
    page = PAGES[name].format("".join(f"<p>{x}</p>" for x in story))
    assert html_text.extract_many([page], html_text.model()) == ["\n\n".join(story)]


def test_text_without_markup():
    assert html_text.extract_many([" ".join(STORY), "a<br>b", "", None], html_text.model()) == [" ".join(STORY), "a b", "", ""]


def test_stray_quotes_end_no_text():
    page = f"<body><p class=x'>{STORY[0]}<p title=\"a > b\">{STORY[1]} It's done<p id='y>{STORY[2]}</body>"
    (got,) = html_text.extract_many([page], html_text.model())
    assert got == "\n\n".join((STORY[0], f"{STORY[1]} It's done", STORY[2]))


def plain_decoding(page, odds, cost):
    """Best score of a subtree and the elements kept, by trying all choices."""
    weight = [np.log1p(o) if o > 0 else 0 for o in page.own]

    def subtree(i):
        return range(i, page.end[i])

    def best(i):
        yes = [min(odds[j], 8) * weight[j] for j in subtree(i)]
        options = [(0.0, set()), (sum(yes), set(subtree(i)))]
        if page.end[i] > i + 1:
            kids = [j for j in subtree(i) if page.parent[j] == i]
            parts = [best(j) for j in kids]
            own = {i} if yes[0] > 0 else set()
            options.append((max(yes[0], 0) - cost + sum(s for s, _ in parts), own.union(*(k for _, k in parts))))
        return max(options, key=lambda x: x[0])

    return best(0)


def test_decoding_against_plain_recursion():
    rng = random.Random(2)

    def tree(depth):
        inner = "".join(tree(depth + 1) for _ in range(rng.randint(0, 3) if depth < 4 else 0))
        return f"<div>{'w' * rng.randint(0, 40)}{inner}</div>"

    for _ in range(60):
        page = html_text.Page(tree(0))
        odds = np.array([rng.uniform(-4, 4) for _ in page.nodes])
        score, kept = plain_decoding(page, odds, html_text.OPEN)
        got = {i for i in np.nonzero(page.keep(odds))[0].tolist() if page.own[i]}
        assert got == {i for i in kept if page.own[i]} and score >= 0
