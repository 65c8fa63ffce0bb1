"""Fixed values. They decide results, so they are stated as they are."""

# Topics in rotation order; order_index is the position, starting at 1.
TOPICS = [
    "Self Management",
    "Yoga",
    "Relationship",
    "Karma",
    "Diet For Happiness",
    "Habits For Happiness",
    "The Perfect Knowledge",
    "The Real Freedom",
]

# Member types, and the profile columns that belong to each.
MEMBER_TYPES = ["studying", "working", "not_studying_not_working"]
PROFILE_COLUMNS = {
    "studying": ["college_name", "branch", "semester"],
    "working": ["company_name", "designation", "experience"],
    "not_studying_not_working": ["description"],
}

# Mark statuses.
PRESENT = "present"
ABSENT = "absent"

# Whitespace that a text trim removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# What a member still needs, and the one-line summaries of promotion.
NEEDS_TOPICS = "Needs to attend "
NEEDS_TOPICS_UNIT = " more class"
NEEDS_TOPICS_PLURAL = "es"
NEEDS_OUTING = "Needs to attend one trip"
NEEDS_SERVICE = "Needs to volunteer once"
PROMOTED = "Promoted"
ELIGIBLE = "Eligible for promotion"
