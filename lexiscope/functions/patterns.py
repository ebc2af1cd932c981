"""Fixed values of the detectors: patterns, word lists and markers, as text in their order.

Patterns are matched ignoring case and in Unicode. ``{term}`` stands for the quoted term.
"""

from __future__ import annotations

#: Fixed values. (language, pattern, category, gender), first hit counts.
COUNTER_STEREOTYPE = (
    ("en", r"\b(father|dad|husband)\b.*(caregiver|nurtur|cook|clean|homemaker|stay.at.home)", "family_role", "male"),
    ("en", r"\b(mother|mom|wife)\b.*(breadwinner|provider|work.*(full.time|office)|career)", "family_role", "female"),
    ("en", r"\b(female|woman|she)\b.*(engineer|mechanic|pilot|ceo|surgeon|firefighter)", "profession", "female"),
    ("en", r"\b(male|man|he)\b.*(nurse|secretary|receptionist|kindergarten|nanny)", "profession", "male"),
    ("en", r"\b(she|her|woman|female)\b.*(lead|command|chief|director|president|boss)", "leadership", "female"),
    ("sw", r"\bbaba\b.+\b(anale[zl]a|anapika|anasafisha|anakaa\s+nyumbani)", "family_role", "male"),
    ("sw", r"\bbaba\b.{0,30}\b(analelea|analinda|anatunza|anasimamia)\s+watoto\s+peke\s+yake\b", "family_role", "male"),
    ("sw", r"\bmama\b.+\b(anafanya\s+kazi\s+ofisi|ni\s+mkurugenzi|anaongoza)", "family_role", "female"),
    ("sw", r"\bmwanamke\b.+\b(mhandisi|rubani|fundi\s+wa\s+magari)", "profession", "female"),
    ("sw", r"\bmwanamume\b.+\b(muuguzi|mkunga|mlezi\s+wa\s+watoto)", "profession", "male"),
    ("sw", r"\bmsichana\b.{0,30}\b(ni\s+rais|ni\s+mkurugenzi|ni\s+kiongozi|anaongoza|ameongoza|amechaguliwa)\b", "leadership", "female"),
    ("sw", r"\bmwanamke\b.{0,30}\b(anaongoza\s+mradi|mkurugenzi\s+mkuu|rubani\s+mkuu|nahodha)\b", "leadership", "female"),
)

#: Fixed values. (language, pattern, category, gender), first hit counts.
DEROGATION = (
    ("en", r"\b(just|only|merely)\s+a\s+(woman|girl|female|housewife)", "capability", "female"),
    ("en", r"\b(woman|women|female|girl).*(can't|cannot|unable|incapable|shouldn't|could\s+never)", "capability", "female"),
    ("en", r"\b(women|woman)\s+(cannot|can't)\s+be\s+(good|great|effective)", "leadership", "female"),
    ("en", r"\b(like\s+a\s+girl|throw.like.a.girl|cry.like)", "capability", "female"),
    ("en", r"\b(too\s+emotional|hysterical|overreact)", "capability", "female"),
    ("en", r"\b(real\s+men\s+don't|man\s+up|be\s+a\s+man)", "capability", "male"),
    ("sw", r"\bni\s+tu\s+(mwanamke|msichana)\b", "capability", "female"),
    ("sw", r"\b(mwanamke|msichana)\b\s+hawezi\b(?!\s+(?:kuzaa|kukoma|kupenda|kunifikia|kufikia|kukufikia|bila\s+kuwezeshwa))", "capability", "female"),
    ("sw", r"\b(kama\s+msichana|kama\s+mwanamke)\b.{0,30}\b(dhaifu|hawezi|haiwezi|hana nguvu|anapiga|analia)", "capability", "female"),
    ("sw", r"\bwanawake\b.{0,40}\b(hawafai|hawawezi|hawapaswi|si wazuri|si hodari|hana uwezo|hawana uwezo)\b", "capability", "female"),
    ("sw", r"\bwanaume\b.{0,40}\b(hawafai|hawawezi|hawapaswi|si wazuri|hawana uwezo)\b.{0,30}\b(huduma|watoto|nyumba|familia)\b", "capability", "male"),
    ("sw", r"\bmsichana\b.{0,40}\b(hakuwepo|alitoroka|hakufika|alishindwa|hakuweza)\b.{0,30}\b(shule|darasa|mtihani|elimu)\b", "education", "female"),
    ("sw", r"\b(mwanamke|msichana|mke)\b.{0,50}\b(mzuri|mrembo|mrefu|mfupi|nzuri|mvuto|mwili).{0,30}\b(lazima|anapaswa|sharti|inahitajika)\b", "appearance", "female"),
    ("sw", r"\b(mwanamke|msichana)\b.{0,30}\b(si mzuri|si mrembo|hana mvuto|mbaya|hana kitu)\b", "appearance", "female"),
    ("sw", r"\bwanawake\b.{0,40}\b(wanaelewa|wanafikiri|wanajua|wanaweza).{0,20}\b(kidogo|tu|chini|zaidi ya)\b", "capability", "female"),
    ("sw", r"\b(wanaume|mwanaume)\b.{0,30}\b(hawalia|hawaonyeshi|usihisi|hisia|kilio)\b", "capability", "male"),
    ("sw", r"\b(mwanamke|mke|mama)\b.{0,50}\b(anapaswa|lazima|sharti|inabidi)\b.{0,40}\b(kupika|kusafisha|kutunza|kubaki nyumbani|nyumbani)\b", "family_role", "female"),
    ("sw", r"\bsisi\s+wanaume\b.{0,60}\b(tunaongoza|tunalazimisha|tunaamua|tunapaswa)\b", "leadership", "male"),
    ("sw", r"\bhata\s+(wanawake|mwanamke|msichana)\b.{0,40}\b(wanaweza|anaweza|wanajeshi|kiongozi|daktari|mhandisi|rubani)\b", "capability", "female"),
    ("sw", r"\balifanya\s+kazi\s+nzuri\s+kwa\s+(mwanamke|msichana)\b", "capability", "female"),
    ("sw", r"\bkwa\s+(mwanamke|msichana)\b.{0,20}\b(alifanya|alifanikiwa|alishinda|alimfaulu)\b", "capability", "female"),
    ("sw", r"\b(aliozeshwa|alipozeshwa|waliozeshwa)\b.{0,30}\b(akiwa\s+na\s+miaka|mdogo|mchanga|kabla)\b", "family_role", "female"),
    ("sw", r"\b(lazima|sharti|inabidi)\b.{0,20}\bamtii\s+mume\b.{0,30}\b(dini|mungu|biblia|quran|kanisa|msikiti)\b", "religion_culture", "female"),
    ("sw", r"\bwanawake\s+wa\s+vijijini\b.{0,50}\b(hawana|hawajui|hawajasomea|hawana\s+elimu|hawajapata)\b", "capability", "female"),
)

#: Fixed values. Where a derogatory phrase is named in order to reject it.
DEROGATION_REJECTED = r"\b(haileti\s+maana\s+kufikiri\s+kuwa|siamini\s+(kuwa|kwamba)|si\s+kweli\s+(kuwa|kwamba)|si\s+sahihi\s+(kuwa|kwamba)|kupinga\s+dhana|tunapinga|hatukubaliani|hii\s+ni\s+dhuluma|ni\s+udhalimu|ni\s+ubaguzi|lazima\s+(tubadilishe|tuzuie|tuondoe))"

#: Fixed values. Gender suffixes of occupations, contexts and words that they don't count with, and occupations' beginnings.
SUFFIXES = (("wa kiume", r"\b(\w+)\s+(wa\s+kiume)\b", "male"), ("wa kike", r"\b(\w+)\s+(wa\s+kike)\b", "female"))
PROGRESS = (
    r"\b(wa\s+kwanza|haki\s+za|usawa\s+wa\s+kijinsia|uwezeshaji|kuhamasisha|ulinzi\s+wa|sheria\s+(ya|inayolinda)|ajenda\s+ya"
    r"|wameshinda|wamepiga|wameweza|wamefanikiwa|wamepewa|wamechaguliwa|wamejiunga|wameimba|wamecheza|wamefanya|wameweka|wamewasili|wamejitokeza|wamekusanyika"
    r"|ameimba|amecheza|amefanikiwa|ameshinda|amepewa|amechaguliwa|ameweza|wanafanya\s+kazi|wanaohusika|wanaohudumu|wanaoshiriki|wanaoimba|wanacheza"
    r"|siku\s+ya\s+wanawake|maadhimisho|sherehe|tamasha|tuzo|zawadi|ushindi|mafanikio|mchango|jitihada|nguvu\s+za)"
)
OCCUPATION_BEGINNINGS = (
    "dakt muuguzi mhand dereva rubani polisi askari waziri rais mgomba msema mwanas mkuru mhudumu mkulima mvuvi mwimb meneja mhasi mpishi "
    "mfanya wakili profes majaji meya mtend mstaa mzalis mlezi fundi kocha mshauri mcheza mwandishi mbunifu mbunge gavana seneta karani nahodha "
    "ofisa afisa mkaguzi msimamizi mwenyekiti mwanauchumi mwanahabari mhusika kiongozi viongozi denti madent wagombea muwakilishi wawakilishi "
    "mwakilishi mwanamichezo wanamichezo rapa mwanaharakati wanaharakati wasomi mwanajeshi wanajeshi mwanachama wanachama maskauti mwamuzi wamuzi "
    "mwangalizi muigizaji waigizaji wafanyakazi mtaalamu wataalamu naibu manaibu kamanda makomanda jenerali majenerali kanali brigadie spika makamu "
    "wauguzi madaktari mkunga wakunga wahudumu mwalimu walimu wakurugenzi jaji hakimu mahakimu wanasheria mlinzi walinzi wafanyabiashara mwekezaji "
    "wawekezaji wahasibu"
).split()
NO_OCCUPATIONS = (
    "wake yake zake lake chake pake wao yao zao lao chao pao wetu yetu zetu letu chetu wenu yenu zenu lenu huyo hao hawa hizi hilo hayo mmoja "
    "wawili watatu wengi wote wengine pekee bora mwingine hasa zaidi sana tu pia mzee mdogo mkubwa mpya mwisho mwana mtoto watoto vijana kijana "
    "mtu watu binadamu rafiki ndugu mwananchi wananchi raia shahidi mshtakiwa"
).split()
CHILD_TERM, CHILD_OF_SOMEONE = r"(mtoto|watoto) wa (kike|kiume)", r"\b(mtoto|watoto)\s+(wake|wao|wangu|wenu)\s+wa\s+(kike|kiume)\b"

#: Fixed values. (condition, patterns) in the order in which conditions are known. Patterns that can't match anywhere are left out.
CONTEXTS = {
    "quote": (
        r'"[^"]{0,100}{term}[^"]{0,100}"', r"'[^']{0,100}{term}[^']{0,100}'", r"«[^»]{0,100}{term}[^»]{0,100}»", r'„[^"]{0,100}{term}[^"]{0,100}"',
        r"\b(alisema|anasema|walisema|said|says|stated|wrote|claimed)\b.{0,50}{term}", r"{term}.{0,50}\b(alisema|anasema|said|says)\b",
    ),
    "historical": (
        r"\b(mwaka\s+)?\d{4}\b.{0,50}{term}", r"{term}.{0,50}\b(mwaka\s+)?\d{4}\b", r"\bin\s+\d{4}\b.{0,30}{term}",
        r"\b(kihistoria|historia|zamani|kale|enzi)\b.{0,50}{term}", r"{term}.{0,50}\b(kihistoria|historia|zamani)\b",
        r"\b(historically|history|ancient|traditional|formerly)\b.{0,50}{term}", r"\b(ilikuwa|walikuwa|alikuwa|was|were|used\s+to)\b.{0,30}{term}",
    ),
    "proper_noun": (
        r"(?<=[a-z])\s+{term}\s+[A-Z][a-z]+", r"(?<=[a-z.,;:]\s)[A-Z][a-z]+\s+{term}", r"\b(Chama\s+cha|Shirika\s+la|Taasisi\s+ya|Kampuni\s+ya)\b.{0,30}{term}",
        r"\b(Organization|Company|Association|Foundation|Institute)\s+.{0,20}{term}", r"{term}.{0,20}\b(Inc|Ltd|LLC|Corp|Foundation)\b",
        r"\b(Mheshimiwa|Dkt\.|Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.)\s+.{0,20}{term}",
    ),
    "biographical": (
        r"\b(yeye|huyu|yule)\s+(ni|alikuwa|amekuwa).{0,30}{term}", r"{term}\s+wa\s+kwanza", r"\baliyekuwa\b.{0,20}{term}", r"\balikuwa\b.{0,20}{term}",
        r"\b(she|he)\s+(is|was|became|served\s+as).{0,30}{term}", r"\bthe\s+first\s+(female|male|woman|man)\s+{term}",
    ),
    "statistical": (
        r"\d+(\.\d+)?%\s*.{0,30}{term}", r"{term}.{0,30}\d+(\.\d+)?%", r"\b(takwimu|idadi|asilimia|wastani)\b.{0,30}{term}",
        r"\b(statistics|data|survey|study|research|percent|majority|minority)\b.{0,30}{term}", r"\b\d+\s+(kati\s+ya|out\s+of|of\s+the)\s+\d+\b.{0,30}{term}",
    ),
    "medical": (
        r"\b(mjamzito|ujauzito|uzazi|kujifungua|mimba)\b.{0,50}{term}", r"{term}.{0,50}\b(mjamzito|ujauzito|uzazi|kujifungua)\b", r"\bmjamzito.{0,10}{term}",
        r"\b(pregnant|pregnancy|childbirth|maternal|obstetric|gynecolog)\b.{0,50}{term}",
        r"\b(saratani\s+ya\s+shingo|cervical\s+cancer|breast\s+cancer|prostate)\b.{0,50}{term}", r"\b(hospitali|clinic|daktari|nurse|doctor|hospital)\b.{0,30}{term}",
    ),
    "counter_stereotype": (
        r"\b(mwanamke|mama)\b.{0,30}\b(mhandisi|rubani|fundi|mkurugenzi|daktari)\b", r"\b(mwanamume|baba)\b.{0,30}\b(muuguzi|mkunga|mlezi|mpishi)\b",
        r"\b(female|woman|she)\b.{0,30}\b(engineer|pilot|mechanic|CEO|surgeon)\b", r"\b(male|man|he)\b.{0,30}\b(nurse|secretary|nanny|caregiver)\b",
        r"\b(wa\s+kwanza|first)\b.{0,20}\b(wa\s+kike|wa\s+kiume|female|male)\b",
        r"\b(haki\s+za\s+(wasichana|wanawake|watoto)|elimu\s+ya\s+(wasichana|watoto))\b.{0,40}{term}", r"{term}.{0,40}\b(haki\s+za\s+(wasichana|wanawake|watoto)|elimu\s+ya\s+(wasichana|watoto))\b",
        r"\b(uwezeshaji|kuhamasisha|ulinzi\s+wa|kampeni\s+ya)\b.{0,40}{term}", r"{term}.{0,40}\b(uwezeshaji|kuhamasisha|ulinzi\s+wa)\b",
        r"\b(usawa\s+wa\s+kijinsia|haki\s+sawa)\b.{0,50}{term}", r"{term}.{0,50}\b(usawa\s+wa\s+kijinsia|haki\s+sawa)\b",
    ),
    "legal": (
        r"\b(sheria|mahakama|kesi|mshtakiwa|mlalamikaji)\b.{0,30}{term}", r"\b(court|legal|plaintiff|defendant|witness|law|statute)\b.{0,30}{term}",
        r"\b(hati|certificate|document|official|sworn)\b.{0,30}{term}",
    ),
    "artistic": (
        r"\b(wimbo|filamu|kitabu|hadithi|mchezo)\b.{0,30}{term}", r"\b(song|film|movie|book|novel|play|poem|lyrics)\b.{0,30}{term}",
        r"\b(mhusika|character|role|actor|actress)\b.{0,30}{term}",
    ),
    "organization": (r"\b(TAWOMA|BAWATA|TAMWA|UWT)\b", r"\bChama\s+cha\s+\w+\s+{term}", r"\b[A-Z]{2,6}\b.{0,20}{term}"),
}
DEFAULT_CONDITIONS = ("quote", "proper_noun", "biographical")
#: Fixed values. With case: names before and after a term, and names with a family word.
NAME_BEFORE, NAME_AFTER = r"[A-Z][a-z]+\s+[A-Z][a-z]+.{0,30}{term}", r"{term}\s+(wa\s+)?[A-Z][a-z]+(\s+[A-Z][a-z]+)?"
FAMILY_NAMES = (r"\b[Mm]ama\s+[A-Z][a-z]+\b", r"\b[Bb]aba\s+[A-Z][a-z]+\b", r"\b(?:Bibi|Babu|Shangazi|Mjomba)\s+[A-Z][a-z]+\b")
#: Fixed values. Possessives, and nouns before them that are things or occupations.
POSSESSIVES = ("yake", "wake", "zake", "lake", "chake")
THINGS = (
    "nyumba ofisi shule duka hospitali kanisa msikiti barabara daraja mlango dirisha chumba jiko paa kadi kitabu barua mkoba mfuko gari ndege basi "
    "simu kompyuta fedha pesa akaunti hati cheti risiti ankara stakabadhi pasipoti leseni kazi elimu afya matibabu biashara mradi mpango tatizo "
    "suluhisho maamuzi hatua matokeo faida hasara thamani bei gharama mishahara mapato mto mlima bahari bonde msitu chakula maji ardhi shamba shirika "
    "kampuni taasisi chama wizara serikali benki chuo mwaka mwezi wiki siku saa dakika"
).split()
PEOPLE = (
    "daktari muuguzi mwalimu rubani dereva mhandisi wakili mbunge waziri rais mkurugenzi meneja kocha mwanasiasa fundi mpishi mkulima mvuvi mhasibu "
    "mwandishi mshauri mchezaji hakimu jaji askari polisi afisa ofisa profesa msomi"
).split()

#: Fixed values. Group markers by language.
GROUPS = {
    "en": ("he his him man men boy father brother".split(), "she her woman women girl mother sister".split(), "they their them person people individual".split()),
    "sw": ("mwanamume baba kaka ndugu".split(), "mwanamke mama dada".split(), []),
}
#: Fixed values. Keywords of the plain keyword detector.
KEYWORDS = {
    "en": "he she his her him chairman waitress policeman businessman".split(),
    "sw": "yeye mwanaume mwanamke baba mama".split(),
    "ha": "shi ita namiji mace".split(),
    "ig": "nwoke nwanyi ya o".split(),
    "yo": "ọkunrin obinrin o oun".split(),
}
#: Fixed values. Noun classes: beginnings in order, the class, and what agrees with it in singular and plural.
NOUN_CLASSES = (("1/2", ("wa", "w")), ("5/6", ("ma",)), ("7/8", ("ki", "ch", "vi", "vy")), ("9/10", ("n",)))
PERSON_BEGINNING, PERSON_STEMS = "m", ("limu", "kulima", "andishi", "fanya")
AGREEMENT = {"1/2": ("a-", "wa-"), "3/4": ("u-", "i-"), "5/6": ("li-", "ya-"), "7/8": ("ki-", "vi-"), "9/10": ("i-", "zi-")}
