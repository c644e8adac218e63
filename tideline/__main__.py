from tideline.api import main

main()
