"""Pages whose wrappers have telling names, and pages in other languages."""

import pytest
from mediaops.llm import main_text

LONG = "It was the first of the long paragraphs that the writer had set out in the order of the day, with all that is in it and more to come. " * 2
ITALIAN = ("Il governo ha approvato nella notte la legge di bilancio per il prossimo anno, con misure a favore delle famiglie e delle imprese che "
           "hanno subito danni durante le alluvioni di ottobre. Secondo il ministro, i fondi saranno disponibili entro pochi mesi.")
POLISH = ("Wczoraj wieczorem w stolicy odbyło się spotkanie przedstawicieli rządu z mieszkańcami dzielnicy, podczas którego omówiono plany budowy "
          "nowej linii tramwajowej oraz remontu mostu. Prace mają rozpocząć się wiosną i potrwać dwa lata.")
CHINESE = "昨天晚上政府代表与居民举行了会议讨论新的电车线路建设计划以及桥梁的维修工程。" * 3


@pytest.mark.parametrize(("html", "text"), [
    (f"<div class='has-sidebar'><article><p>{LONG}</p></article></div>", LONG.strip()),
    (f"<div id='page-header-fixed'><article><p>{LONG}</p></article></div>", LONG.strip()),
    (f"<div class='sidebar-left'><main><p>{LONG}</p></main></div>", LONG.strip()),
    (f"<article><div class='article-header'><h1>Head line</h1></div><p>{LONG}</p></article>", f"Head line\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p></article><div class='comments-area'><article><p>{LONG}</p></article></div><nav><article>{LONG}</article></nav>", LONG.strip()),
    (f"<article><p>{LONG}</p><div class='main-menu-container'>{LONG}</div><div class='related-posts'><article>{LONG}</article></div></article>", LONG.strip()),
    (f"<div><p>{ITALIAN}</p><p>{ITALIAN[:90]}</p></div>", f"{ITALIAN}\n{ITALIAN[:90].strip()}"), (f"<p>{POLISH}</p>", POLISH), (f"<p>{CHINESE}</p>", CHINESE),
    (f"<p><a href=x>{POLISH}</a></p><p>{POLISH}</p>", POLISH),
])
def test_wrapped_pages_and_other_languages(html, text):
    assert main_text.main_text(html) == text
