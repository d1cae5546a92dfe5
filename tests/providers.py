"""Stand-ins for models, named on the command line in tests."""


def lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


def narrator(request):
    return "1. Do this.\n\n2) Then that."
