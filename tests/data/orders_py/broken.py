def oops(:
    pass
