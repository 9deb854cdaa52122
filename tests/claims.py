"""What a masked text must be, from a claim per character: every match asks for
its characters, earlier rules first; a match is granted if all are free.  Numbers
are ranks in the sorted list of granted claims."""


def allowed(word_text, rule):
    words = word_text.split()
    return not set(words) & set(rule.exclusions) and all(len(w) >= rule.min_word_length for w in words)


def matches(text, rules):
    return [(k, m.start(), m.end(), m.group()) for k, r in enumerate(rules) if r.regex is not None
            for m in r.compiled.finditer(text) if allowed(m.group(), r)]


def granted(text, rules, entities=()):
    owner, out = [None] * len(text), []
    wanted = [c for c in matches(text, rules) if not (entities and rules[c[0]].entity)]
    wanted += [(k, s, e, text[s:e]) for k, r in enumerate(rules) if r.entity for s, e, label in entities
               if label in r.labels and allowed(text[s:e], r)]
    for k, s, e, v in sorted(wanted):
        if all(o is None for o in owner[s:e]):
            owner[s:e] = [k] * (e - s)
            out.append((k, s, e, v))
    return out


def render(rule, n, first):
    if rule.template == "preserve_length":
        return f"{n:0{len(first)}d}"
    return rule.template.format(n=n, orig=first, orig_len=len(first))


def masked(text, rules, entities=()):
    """The masked text and its mapping."""
    if not (text or "").strip():
        return text, {}
    claims = granted(text, rules, entities)
    first = {}
    for k, s, e, v in claims:  # in order of (rule, start)
        first.setdefault((rules[k].name, v.strip()), (k, v))
    number, names = {}, {}
    for name, key in first:
        number[name, key] = sum(other == name for other, _ in number) + 1
        names[name, key] = render(rules[first[name, key][0]], number[name, key], first[name, key][1])
    out, at = "", 0
    for k, s, e, v in sorted(claims, key=lambda c: c[1]):
        out += text[at:s] + names[rules[k].name, v.strip()]
        at = e
    return out + text[at:], {p: key for (_, key), p in names.items()}
