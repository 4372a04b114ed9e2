"""Fits the n-gram models: python -m marlstone.llm.train_residue TABLE.parquet OUT.npz

Filler and notices begin with the seeds below; natural text is what the labeller takes for title, price, facts, text and
replies on a sample of at most MAX_PAGES pages. Two rounds of self-training move the fields that the models find from
natural text to their own kind.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from . import page_labeller as M
from .residue import FIELD_COVER, TEXT_COVER, Ratios, fields
from .train_pages import prepare

MAX_PAGES = 12000
ROUNDS = 2

# Forms of template places, with a name for %s.
PLACES = ["{{ %s }}", "{{%s}}", "{{{%s}}}", "${%s}", "<%%= %s %%>", "%%%%%s%%%%", "[[%s]]", "[%s]", "@Model.%s", "__%s__", "#{%s}", "{%% block %s %%}{%% endblock %%}", "<?php echo $%s ?>", "%s_HERE", "{%s}", "{{ product.%s }}", "{{ item.%s }}", "${item.%s}", "#{listing.%s}", "[product_%s]", "%%%%ITEM_%s%%%%", "$%s$", "<%s>", "{{> %s}}", "@{%s}"]
NAMES = ["title", "name", "price", "description", "body", "text", "content", "amount", "vendor", "NAME", "TITLE", "PRICE", "DESCRIPTION", "TEXT", "Title", "Name", "Description", "Price", "stock"]
NUMBERED = ["Ships {0} within {1} days", "Posted by {0} on {1}", "{0} of {1} in stock", "Price: {0}", "Product {0}", "Sold by {0}", "Dear {0}, your order {1}", "Only {0} left", "{0} by {1}", "{0} pieces at {1} each", "{0} {1} {2}"]
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure".split()
FILLERS = ["xxxxx xxxxx xxxxx", "asdf asdf asdf", "qwerty qwerty", "blah blah blah", "test test test", "foo bar baz", "aaa bbb ccc", "Coming soon coming soon coming soon", "Coming soon", "Sample text, replace before publishing.", "INSERT TEXT HERE", "Your text here.", "Add your text here", "Product description goes here.", "Title goes here", "Type your description in this box.", "Write something nice about your item.", "Enter a description", "Hier steht Ihr Text.", "Ihr Text hier", "Votre texte ici.", "Su texto aquí.", "Escriba aquí su texto.", "Seu texto aqui.", "Здесь ваш текст.", "Введите описание.", "This is a demo item for testing purposes. No orders shall be fulfilled.", "This is placeholder text.", "Dummy text", "Untitled", "Sample product", "Sample listing", "New listing (copy)", "New product", "Test item 1", "Test product", "undefined", "null", "NaN", "$NaN", "[object Object]", "TBD", "TODO", "NAME_HERE", "no title", "Default title", "Product name", "Example product"]
NOTICES = ["404 Not Found", "The page you asked for is not here any more.", "Page not found", "This page does not exist.", "500 Internal Server Error", "502 Bad Gateway", "503 Service unavailable", "504 Gateway timeout", "The service is down for maintenance, back in 10 minutes.", "Something went wrong on our side. Try again later.", "Oops! An error occurred. Error id 12.", "Database error: too many connections (code 1040)", "Traceback (most recent call last): KeyError: item 7", "Fatal error: uncaught exception", "Access denied", "You do not have permission to view this item.", "Forbidden", "Your session has expired. Please log in again to continue.", "Please sign in to view this page.", "Too many requests. Slow down and retry after 30 seconds.", "You are in the access queue. Estimated wait: 5 minutes. Keep this tab open.", "This listing is no longer available. The vendor has removed it.", "This item has been deleted.", "This post was removed by the moderators.", "Please enable JavaScript to view this site.", "JavaScript is required. Turn scripts on in your browser and reload the page.", "You need to allow scripts to run this app.", "Checking your browser before you enter. This takes about 5 seconds. Scripts must be allowed.", "Verify that you are human to go on.", "Seite nicht gefunden. Der Artikel wurde entfernt oder die Adresse ist falsch.", "Interner Serverfehler", "Zugriff verweigert", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich an.", "Bitte aktivieren Sie JavaScript, um die Seite zu nutzen.", "Erreur interne du serveur. Réessayez dans 5 minutes.", "Page introuvable", "Accès refusé", "Cette application a besoin de scripts pour fonctionner.", "Veuillez activer JavaScript.", "La página solicitada no existe. Código 404", "Acceso denegado", "Para continuar debe activar JavaScript en su navegador.", "Página não encontrada", "Acesso negado", "Ative o JavaScript para continuar.", "Erro interno do servidor", "Страница не найдена. Запрошенный товар был удалён.", "Доступ запрещён", "Включите JavaScript, чтобы продолжить.", "Внутренняя ошибка сервера", "Error", "Gone", "Rate limit", "Queue"]
# Natural mentions, written for this library.
MENTIONS = ["The shop says page not found whenever I open my order, anyone else?", "Why do I get a bad gateway on the mirror?", "My session expired all day, please help.", "A seller left lorem ipsum and {{ name }} in the text, so I reported it.", "The queue page tells me to enable JavaScript and I would rather not.", "My browser showed an error at checkout, the vendor fixed it.", "No JavaScript needed to order here.", "Test strips are sold apart; this is not a sample.", "Strips come as {2 x 10}, see the photo [front].", "Printed by Lorem & Sons on the back.", "The placeholder photo shows the old box.", "Please enable JavaScript, really?", "502 Bad Gateway on the main mirror?", "Lorem ipsum in a listing"]
# Field values that are no residue.
VALUES = ["[verified]", "N/A", "Sold out", "on request", "price in chat", "contact vendor"]


def seeds() -> tuple[list[str], list[str]]:
    r = random.Random(3)
    filler = [p % n for p in PLACES for n in NAMES] + NUMBERED * 4 + FILLERS * 14
    for _ in range(300):
        at = r.randrange(len(LATIN))
        n = r.randrange(5, 20)
        words = [LATIN[(at + k) % len(LATIN)] for k in range(n)] if r.random() < 0.6 else r.choices(LATIN, k=n)
        filler.append(" ".join(words).capitalize() + ".")
    return filler, NOTICES * 6


def main(table: str, out: str) -> None:
    pages, _, _ = prepare(table)
    pages = pages[:MAX_PAGES]
    roles = M.Labeller.load().roles(pages)
    f = [fields(t, r) for (t, _), r in zip(pages, roles)]
    other = [" ".join(x.strip() for x, k in zip(t, r) if k in (M.FACT, M.REPLY)) for (t, _), r in zip(pages, roles)]
    filler, notices = seeds()
    ratios = None
    for k in range(ROUNDS + 1):
        covers = ratios.cover([x for g in f for x in g[:3]]) if ratios else np.zeros((3 * len(f), 3))
        more_f, more_n, natural = [], [], MENTIONS * 25 + VALUES * 400 + [x for x in other if x]
        for n, (ti, pr, te, _) in enumerate(f):
            for k2, (text, least) in enumerate(((ti, 0.9), (pr, FIELD_COVER), (te, TEXT_COVER))):
                if not text:
                    continue
                c = covers[3 * n + k2]
                if c[0] >= least and c[0] >= c[1]:
                    more_f.append(text)
                elif c[2] >= least and (text is te or not te):
                    more_n.append(text)
                else:
                    natural.append(text)
        ratios = Ratios.fit(filler + more_f, notices + more_n, natural)
        print("round", k, "filler", len(more_f), "notices", len(more_n), "natural", len(natural), flush=True)
    np.savez_compressed(out, tables=ratios.tables.astype(np.float16))


if __name__ == "__main__":
    main(*sys.argv[1:])
