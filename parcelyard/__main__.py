from parcelyard.plans.commands import main

main()
