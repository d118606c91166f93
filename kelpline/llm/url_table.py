"""The labelled URLs that the filter learns from: a small table made by rule from invented addresses."""

from __future__ import annotations

import random

#: Words of addresses that are to be blocked, by topic.
BAD = """adult xxx porn escort sexy singles dating hookup webcam nude casino slots poker betting jackpot roulette lottery bingo
viagra cialis pills pharmacy steroids diet slimming miracle loan payday cash credit debt forex bitcoin crypto giveaway prize winner
bonus promo coupon discount cheap replica rolex spam farm seo backlinks clicks popup adserver tracker banner affiliate referral
warez crack keygen torrent nulled cheats hack free-download stream-hd leaked clickbait doorway cloaking linkfarm""".split()
#: Words of ordinary addresses.
GOOD = """news report journal article library museum university school college hospital clinic city council weather forecast garden
recipes soup bread travel railway station timetable history archive science physics biology geology research papers docs manual guide
install reference tutorial forum thread wiki encyclopedia blog diary photo gallery cycling football chess music orchestra theatre
cinema parliament court law statistics census maps mountain river island coast bird insect forest kitchen pottery carpentry code
project software release astronomy telescope calendar events contact about team""".split()
SYLLABLES = "an ba ber da en er fo gra hal ing ka le lor ma men mi na nor on or pa que ra ri sa sel ta ther ti ton un ve wen zo".split()


def labelled_urls(size: int = 1200, seed: int = 41, bad: list[str] | None = None, good: list[str] | None = None) -> list[tuple[str, int]]:
    """``size`` URLs, half of them labelled 1 (block).  A bad one has one or two of the bad words in its host or path; both kinds share
    prefixes, domains, made-up names, languages, numbers and queries.  Other word lists serve to hold words out."""
    rng, lists = random.Random(seed), {1: bad or BAD, 0: good or GOOD}

    def name() -> str:
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))

    def url(label: int) -> str:
        words = rng.sample(lists[label], 2)
        kind = rng.randrange(4)
        own = [rng.choice(["-".join(words), f"{words[0]}-{name()[:4]}", words[0]]), name(), name(), rng.choice([f"{words[0]}{rng.randrange(99)}", "".join(words)])][kind]
        plain = label == 0 and rng.random() < 0.6  # most ordinary hosts are just names
        host = f"{rng.choice(['', '', 'www.', 'm.', 'blog.'])}{name() if plain else own}.{rng.choice(['com', 'org', 'net', 'fr', 'de', 'info', 'example.com', 'example.org', 'example.net'])}"
        place = f"/{rng.choice(['en', 'de', 'fr', 'es'])}" if rng.random() < 0.6 else ""
        tail = rng.choice([f"/{rng.randrange(1, 10_000)}", f"/{rng.randrange(1, 10_000)}.html", f"/{rng.randrange(1, 10_000)}/"])
        path = f"/{'/'.join(words)}{tail}" if own not in host or kind in (1, 2) and not plain or rng.random() < 0.3 else tail
        if plain and rng.random() < 0.5:
            path = tail
        return f"{rng.choice(['http', 'https'])}://{host}{place}{path}{rng.choice(['', '', '?page=2', '#top', '?utm_source=feed'])}"

    return [(url(i % 2), i % 2) for i in range(size)]
