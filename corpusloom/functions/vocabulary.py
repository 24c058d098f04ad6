"""Words that say nothing of a text's subject."""

from __future__ import annotations

#: English function words of two letters or more, a fixed list; callers with a longer one pass it instead.
STOPS = (
    "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "cannot", "could", "did", "do", "does", "down", "during", "each", "either", "else", "ever", "every", "few", "for", "from", "further", "had", "has", "have",
    "he", "hence", "her", "here", "hers", "him", "his", "how", "however", "if", "in", "into", "is", "it", "its", "just", "least", "less", "many", "may", "me", "might", "more", "most", "much",
    "must", "my", "neither", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out", "over", "own", "per", "rather", "same", "she", "should", "since", "so",
    "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "thus", "to", "too", "under", "until", "up", "upon", "us", "very", "was",
    "we", "were", "what", "when", "where", "which", "while", "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you", "your", "yours",
)
